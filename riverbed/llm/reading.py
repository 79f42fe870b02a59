"""Reading level of pages: a linear pairwise ranker of their prose, calibrated to grades by isotonic regression.

A lexicon of the corpus comes first: which words go with lines that look like advertisements, which with English pages,
and how rare they are, counted over all pages; their ``lang`` is taken as it is.  Measurements of every page are then
taken in one pass without a shuffle.  The ranker learns from all pairs of graded pages which of two reads harder: pairs
are summed over cells of equal grade and nearly equal score, so that each step of the fit is one pass over the graded
pages.  The monotone curve that turns scores into years of schooling is that of all graded pages, too, found by ranges
of the scores.  Both are then a few numbers that go with the expression that grades all pages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.prose import FEATURES, Lexicon, learned, measure, samples
from riverbed.llm.prose import _WORD as WORD
from riverbed.session import cut as checkpointed

#: Least count of a word of the lexicon, and words that a task counts before it hands their counts on.
LEAST_COUNT, WORDS_HELD = 5, 500_000
#: Width of a cell of scores and the score beyond which all count alike, in log-odds; cells of grades to a year; graded pages to a task.
BIN, FAR, TO_A_YEAR, TASK_PAGES = 0.125, 64.0, 16, 20_000
#: Running English: words of prose, mean log-odds of its words for English, letters among the characters.
LEAST_WORDS, LEAST_ENGLISH, LEAST_LEGIBLE = 25, 0.0, 0.85


#: Stands for a null edge of a box.
UNKNOWN = -(1 << 31)


def _pages(batch: pa.RecordBatch, text: str, boxes: str | None) -> Iterator[tuple[str | None, np.ndarray | None, np.ndarray | None]]:
    """Texts with the left and right edges of their lines; None where there are no boxes or a null among them."""
    texts = batch.column(batch.schema.get_field_index(text))
    if boxes is None:
        yield from ((t.as_py(), None, None) for t in texts)
        return
    b = batch.column(batch.schema.get_field_index(boxes))
    at, there = b.offsets.to_numpy(), b.is_valid().to_numpy(zero_copy_only=False)
    edges = [pc.if_else(b.values.is_valid(), b.values.field(b.values.type.get_field_index(c)), None).fill_null(UNKNOWN).to_numpy(zero_copy_only=False) for c in ("x0", "x1")]
    for i, t in enumerate(texts):
        x0, x1 = (e[at[i] : at[i + 1]] for e in edges)
        whole = there[i] and len(x0) and min(x0.min(), x1.min()) > UNKNOWN
        yield t.as_py(), *((x0, x1) if whole else (None, None))


def corpus_lexicon(df: DataFrame, page: str, text: str, lang: str, boxes: str | None = None, sample: int | None = None) -> Lexicon:
    """The lexicon of a corpus, from all its pages (about ``sample`` of them if that is given); empty for one without texts.

    Labels of English begin with ``en`` in any case; pages without a label, or with ``und``, tell nothing of languages.
    Only words that occur ``LEAST_COUNT`` times in them are kept.
    """
    pages = df.where(F.col(text).isNotNull())
    if sample is not None:
        share = min(1.0, sample / max(1, df.count()))
        pages = pages.where(F.pmod(F.xxhash64(page), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def told(counts: list[Counter[str]]) -> pa.RecordBatch:
        words = list(set().union(*counts))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in counts]], ["word", "c0", "c1", "c2", "c3"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter[str]] = [Counter() for _ in range(4)]
        for batch in batches:
            for (t, x0, x1), label in zip(_pages(batch, text, boxes if boxes else None), batch.column(0)):
                label = (label.as_py() or "und").strip().lower()
                english = label.startswith("en")
                if label != "und":
                    counts[2 if english else 3].update(WORD.findall(t.lower()))
                if english:
                    for kind, lines in enumerate(samples(t, x0, x1)):
                        counts[kind].update(WORD.findall("\n".join(lines).lower()))
            if sum(map(len, counts)) > WORDS_HELD:
                yield told(counts)
                counts = [Counter() for _ in range(4)]
        yield told(counts)

    counted = pages.select(lang, text, *([boxes] if boxes else [])).mapInArrow(run, "word string, c0 long, c1 long, c2 long, c3 long")
    words = counted.groupBy("word").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)]).where(F.col("c2") + F.col("c3") >= LEAST_COUNT)
    return learned(list(zip(*(c.to_pylist() for c in words.toArrow().columns))))


def page_features(df: DataFrame, text: str, keep: list[str], lexicon: Lexicon, boxes: str | None = None) -> DataFrame:
    """The columns ``keep``, ``features`` (see ``prose.FEATURES``), ``words``, ``english`` and ``legible``.

    The last four are null for a null, empty or blank text and for one without prose.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t, lexicon, x0, x1) for t, x0, x1 in _pages(batch, "__text", "__boxes" if boxes else None)]
            f = pa.array([m and m[0] for m in found], pa.list_(pa.float64()))
            rest = [pa.array([m and m[i] for m in found], pa.float64()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], f, *rest], [*keep, "features", "words", "english", "legible"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("__text"), *([F.col(boxes).alias("__boxes")] if boxes else [])).mapInArrow(run, f"{schema}, features array<double>, words double, english double, legible double")


@dataclass
class Levels:
    """Weights of the measurements and the knots of the curve from score to grade."""

    weights: list[float]
    scores: list[float]
    grades: list[float]

    def score(self, features: str = "features"):
        return F.aggregate(F.zip_with(features, F.array(*[F.lit(w) for w in self.weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def level(self, features: str = "features"):
        """The grade as a column; null where the measurements are."""
        scores, grades = np.array(self.scores), np.array(self.grades)

        @F.pandas_udf("double")
        def calibrated(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s.to_numpy(dtype=float, na_value=np.nan), scores, grades))

        return F.when(F.col(features).isNotNull(), calibrated(self.score(features)))


def _cells(z: np.ndarray, grades: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(grade, bin)`` of each cell, and the sums over its rows of 1, the columns and their products.

    A row is divided between the two bins nearest to its score, which makes all sums over pairs interpolations.
    """
    s = np.clip(z @ w, -FAR, FAR) / BIN
    low, (i, j) = np.floor(s), np.triu_indices(z.shape[1])
    m, g = np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]]), np.round(grades * TO_A_YEAR) / TO_A_YEAR
    cells, at = np.unique(np.c_[np.r_[g, g], np.r_[low, low + 1]], axis=0, return_inverse=True)
    sums = np.zeros((len(cells), m.shape[1]))
    np.add.at(sums, at.ravel(), np.r_[m * (1 - s + low)[:, None], m * (s - low)[:, None]])
    return cells, sums


def _pairs(cells: np.ndarray, sums: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of pairs with grades a year or more apart; slope and curvature of the log-likelihood of their order."""
    order = np.lexsort((cells[:, 1], cells[:, 0]))
    cells, sums = cells[order], sums[order]
    bins, at = np.unique(cells[:, 1], return_inverse=True)
    grades, first = np.unique(cells[:, 0], return_index=True)
    rows = [slice(a, b) for a, b in zip(first, [*first[1:], len(cells)])]
    wrong = 1 / (1 + np.exp(BIN * (bins[:, None] - bins)))
    below, done = np.zeros((len(bins), sums.shape[1])), 0
    n, slope, squares, cross = 0.0, np.zeros(k), np.zeros(sums.shape[1] - 1 - k), np.zeros((k, k))
    for g, here in zip(grades, rows):
        while grades[done] <= g - 1:
            below[at[rows[done]]] += sums[rows[done]]
            done += 1
        m, p = sums[here], wrong[at[here]]
        t, u = p @ below[:, : k + 1], (p * (1 - p)) @ below
        n += m[:, 0].sum() * below[:, 0].sum()
        slope += m[:, 1 : k + 1].T @ t[:, 0] - m[:, 0] @ t[:, 1:]
        squares += u[:, 0] @ m[:, k + 1 :] + m[:, 0] @ u[:, k + 1 :]
        cross += m[:, 1 : k + 1].T @ u[:, 1 : k + 1]
    bend = np.zeros((k, k))
    bend[np.triu_indices(k)] = squares
    return n, slope, np.triu(bend) + np.triu(bend, 1).T - cross - cross.T


def _newton(k: int, cells: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], penalty: float) -> np.ndarray:
    """Weights of the pairwise logistic model, from the cells that each step's weights give."""
    w = np.zeros(k)
    for _ in range(30):
        n, slope, bend = _pairs(*cells(w), k)
        if n < 0.5:  # parts of rows add up to whole pairs, but for rounding
            break
        step = np.linalg.solve(bend / n + np.eye(k) * (penalty / 100 + 1e-9), slope / n - penalty * w / 100)
        w = w + step
        if np.abs(step).max() < 1e-4 * (1 + np.abs(w).max()):
            break
    return w


def rank_weights(x: np.ndarray, grades: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model of which of two rows has the higher grade, by Newton steps over all pairs of rows."""
    spread = np.maximum(x.std(0), 1e-9)
    z = (x - x.mean(0)) / spread
    return _newton(x.shape[1], lambda w: _cells(z, grades, w), penalty) / spread


def _spark_weights(known: DataFrame, mean: np.ndarray, spread: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """``rank_weights`` of the columns ``features`` and ``grade``: a pass over them for each step."""
    k = len(mean)
    names = [f"s{i}" for i in range(1 + k + k * (k + 1) // 2)]

    def cells(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = batch.column(0).flatten().to_numpy().reshape(-1, k)
                    c, s = _cells((x - mean) / spread, batch.column(1).to_numpy(), w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in (*c.T, *s.T)], ["g", "bin", *names])

        parts = known.select("features", "grade").mapInArrow(run, ", ".join(f"{c} double" for c in ("g", "bin", *names)))
        found = parts.groupBy("g", "bin").agg(*[F.sum(c).alias(c) for c in names]).toPandas().to_numpy(float)
        return found[:, :2], found[:, 2:]

    return _newton(k, cells, penalty) / spread


def _blocks(scores: np.ndarray, grades: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators of what is in order already: rows of mean score, mean grade and count.  Blocks of parts may be pooled again."""
    blocks: list[list[float]] = []
    for s, g, n in zip(scores.tolist(), grades.tolist(), counts.tolist()):
        blocks.append([s, g, n])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            s1, g1, n1 = blocks.pop()
            s0, g0, n0 = blocks[-1]
            blocks[-1] = [(s0 * n0 + s1 * n1) / (n0 + n1), (g0 * n0 + g1 * n1) / (n0 + n1), n0 + n1]
    return np.array(blocks).reshape(-1, 3)


def isotonic(scores: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: mean score and mean grade of each block of the best rising step curve; equal scores lie in one block."""
    order = np.lexsort((-grades, scores))
    blocks = _blocks(scores[order], grades[order], np.ones(len(order)))
    return blocks[:, 0], blocks[:, 1]


def _spark_isotonic(scored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``isotonic`` of the columns ``score`` and ``grade``: ranges of scores apart, then their blocks together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3))
        for batch in batches:
            rows = np.c_[batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.ones(len(batch))]
            held = _blocks(*np.r_[held, rows].T)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in held.T], ["score", "grade", "n"])

    ranges = scored.select("score", "grade").repartitionByRange("score").sortWithinPartitions("score", F.col("grade").desc())
    blocks = ranges.mapInArrow(run, "score double, grade double, n double").orderBy("score").toPandas().to_numpy(float)
    blocks = _blocks(*blocks.T)
    return blocks[:, 0], blocks[:, 1]


def fit_levels(pages: DataFrame, labels: DataFrame, page: str = "doc_id", grade: str = "grade") -> Levels | None:
    """Levels from all graded pages; None where fewer than two of them have both prose and a grade, or all have one grade.

    Of several grades of a page the median counts; null grades count not.
    """
    graded = labels.where(F.col(grade).isNotNull() & F.col(page).isNotNull()).groupBy(page).agg(F.median(grade).alias("grade"))
    known = checkpointed(pages.where("features IS NOT NULL").select(page, "features").join(graded, page).select("features", "grade"))
    each = [F.col("features")[i] for i in range(len(FEATURES))]
    n, least, most, *moments = known.agg(F.count("*"), F.min("grade"), F.max("grade"), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    if n < 2 or least == most:
        return None
    known = known.coalesce(-(-n // TASK_PAGES))
    mean, spread = np.array(moments, float).reshape(2, -1)
    found = Levels(_spark_weights(known, mean, np.maximum(spread, 1e-9)).tolist(), [], [])
    s, g = _spark_isotonic(known.select(found.score().alias("score"), "grade"))
    return Levels(found.weights, s.tolist(), g.tolist())


def reading_levels(df: DataFrame, labels: DataFrame, page: str = "doc_id", text: str = "text", lang: str = "lang", boxes: str | None = None, cut=None) -> DataFrame:
    """``(page, level, words, english, legible, running)`` for every row of ``df``.

    ``level`` is in years of schooling on the scale of the grades in ``labels``, null for pages without any prose and
    for all pages where there are too few grades to learn from.  ``running`` tells pages of legible running English
    from price lists, scraps, illegible pages and other languages.  ``boxes`` names the boxes of the lines, if any.
    """
    lexicon = corpus_lexicon(df, page, text, lang, boxes)
    pages = page_features(df, text, [page], lexicon, boxes)
    pages = cut(pages) if cut else pages
    levels = fit_levels(pages, labels, page)
    level = levels.level() if levels else F.lit(None).cast("double")
    running = F.coalesce((F.col("words") >= LEAST_WORDS) & (F.col("english") > LEAST_ENGLISH) & (F.col("legible") >= LEAST_LEGIBLE), F.lit(False))
    return pages.select(page, level.alias("level"), "words", "english", "legible", running.alias("running"))
