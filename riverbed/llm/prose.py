"""What the running prose of a scanned page is like: words, sentences, syllables, connectives, vocabulary.

A page is put in order first: lines set across columns are cut at the gutter, and lines go column by column where boxes
tell the columns.  Headings, page lines and leaders are left out by their form.  Advertisements are told by what no list
of theirs is needed for: some lines look like one (an opening in capitals that a mark sets off, a price, doubled
exclamation marks), a short line ends a paragraph, and a ``Lexicon`` learned from the corpus says which words such lines
have that others don't.  A line that looks like an advertisement but has the words of articles stays.

Words broken at line ends are joined.  Damage that changes neither the length of a word nor its vowels much does not
matter for the averages taken here.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate
from math import log
from operator import itemgetter

import numpy as np

#: Columns of a page's measurements, in order.
FEATURES = ["sentence_words", "log_sentence_words", "syllables", "letters", "long_words", "hard_words", "easy_words", "commas", "clauses", "breaks", "rarity"]

#: Words that join clauses (fixed values).
JOINING = frozenset("which who whom whose that because although though while when where wherein whereof whereupon whenever unless until if as since provided whether than notwithstanding irrespective whatever hitherto".split())

_GUTTER = re.compile(r"\s+\|\s+|\s{2,}|\t")
_SMALL = re.compile(r"[a-zà-ÿſ]{3}")
_LOOKS = re.compile(r"[£\d](?:[\d,. ]*\d)? ?(?:[sd]\b|/\d)|£|!!|^[A-Z]{2,}(?: [A-Z]{2,})*[,.;:]", re.M)
_BREAK = re.compile(r"[-=¬‐­‑–]\s*\n\s*")
_WORD = re.compile(r"[a-zà-ÿſﬁﬂ]+")
#: An end of a sentence: a mark that follows no title and no initial, before a capital (the blank may be lost) or at the end of a line.
_END = re.compile(r"[.!?](?<![A-Z]\.)(?<!\b[MD]r\.)(?<!\bMrs\.)(?<!\b[CN]o\.)(?<!\bSt\.)[^\w\s]?(?=\s+[^\w\s]?[A-Z0-9]|(?<=[a-z][.!?])[A-Z][a-z]|\s*\n|\s*$)")
_VOWELS = re.compile(r"[aeiouyàáâäèéêëìíîïòóôöùúûü]+")
_FOLD = str.maketrans({"ſ": "s", "ﬁ": "fi", "ﬂ": "fl"})

#: Pixels between the left edges of two columns; the part of its column's width below which a line is short.
COLUMN_GAP, SHORT = 60, 0.65
#: Log-odds per word above which a line is one of an advertisement: one that looks like it, one after such a line (a short one, another), one before.
ALIKE, SHORT_AFTER, AFTER, BEFORE = -1.0, -0.5, 0.3, 0.7
#: Lines that an advertisement may have after one that looks like it.
TAIL = 3


@dataclass
class Lexicon:
    """What a corpus says of its words: log-odds of advertisements over articles and of English over other languages, rarity."""

    words: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    _rows: _Rows | None = field(default=None, repr=False, compare=False)

    def advert(self, line: str) -> float:
        """Mean log-odds of the known words of a line, 0 where none is known."""
        odds = [w[0] for w in map(self.words.get, _WORD.findall(line.lower())) if w]
        return sum(odds) / len(odds) if odds else 0.0

    def sums(self, words: list[str]) -> list[float]:
        """Sums of what ``_words`` and the lexicon (how many are known, their log-odds for English, their rarity) have of words."""
        if self._rows is None or len(self._rows) > 200_000:
            self._rows = _Rows(self.words)
        at = list(map(self._rows.__getitem__, words))
        return sum(self._rows.table[at[i : i + 10_000]].sum(0) for i in range(0, len(at), 10_000)).tolist()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None}


def learned(counts: list[tuple[str, int, int, int, int]]) -> Lexicon:
    """From ``(word, in adverts, in articles, in English, in other languages)``, with a count of 1 added to each."""
    sums = np.array([c[1:] for c in counts], float).reshape(-1, 4).sum(0) + len(counts) + 1
    odds = lambda a, b, n, m: log((a + 1) / n) - log((b + 1) / m)
    total = sums[2] + sums[3]
    return Lexicon({w: (odds(a, p, sums[0], sums[1]), odds(e, o, sums[2], sums[3]), -log((e + o + 1) / total)) for w, a, p, e, o in counts})


def syllables(word: str) -> int:
    w = word.translate(_FOLD)
    n = len(_VOWELS.findall(w))
    if n > 1 and w.endswith("e") and not w.endswith("le"):
        n -= 1
    elif n > 1 and w.endswith(("es", "ed")) and w[-3:-2] not in "td" and not w.endswith(("ses", "zes", "ces", "ges", "les")):
        n -= 1
    return max(1, n)


class _Words(dict):
    """What is counted of a lower-case word, remembered; a worker forgets all when it has seen very many."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        n, size = syllables(word), len(word)
        self[word] = found = (n, size, n >= 3, n >= 4, size <= 3, word in JOINING)
        return found


_words = _Words()


class _Rows(dict):
    """The row of ``table`` for each word seen: what ``_words`` and a lexicon have of it."""

    def __init__(self, lexicon: dict[str, tuple[float, float, float]]) -> None:
        super().__init__()
        self.lexicon, self.table = lexicon, np.empty((1024, 9))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        found = self.lexicon.get(word)
        self.table[at] = (*_words[word], *((1, found[1], found[2]) if found else (0, 0, 0)))
        self[word] = at
        return at


def lines_in_order(text: str, x0: np.ndarray | None = None, x1: np.ndarray | None = None) -> list[tuple[str, bool]]:
    """Lines column by column, those set across columns in their parts; and whether each is short for its column.

    ``x0`` and ``x1`` are the edges of the lines; where they are missing or are not one a line, columns are those of the
    gutters alone and lengths are taken in characters.
    """
    lines = text.replace("\r", "").split("\n")
    boxed = x0 is not None and x1 is not None and len(x0) == len(lines) > 0
    if boxed:
        left, ends = x0.tolist(), x1.tolist()
        order = sorted(range(len(lines)), key=left.__getitem__)
        column, start, right = [0] * len(lines), [left[order[0]]], [-1]
        last = start[0]
        for i in order:
            if left[i] - last > COLUMN_GAP:
                start.append(left[i])
                right.append(-1)
            last, column[i] = left[i], len(start) - 1
            right[-1] = max(right[-1], ends[i])
        least = [a + SHORT * (b - a) for a, b in zip(start, right)]
        short = [e < least[c] for e, c in zip(ends, column)]
    else:
        sizes = sorted(len(line) for line in lines)
        least = SHORT * sizes[len(sizes) * 9 // 10]
        column, short = [0] * len(lines), [len(line) < least for line in lines]
    out = []
    for line, c, s in zip(lines, column, short):
        if "  " in line or " | " in line or "\t" in line:
            parts = [p for p in _GUTTER.split(line.strip()) if p]
            out += [(c, i, p, s if len(parts) == 1 else len(p) < 12) for i, p in enumerate(parts)]
        elif line:
            out.append((c, 0, line, s))
    out.sort(key=itemgetter(0, 1))
    return [x[2:] for x in out]


def body_lines(text: str, x0: np.ndarray | None = None, x1: np.ndarray | None = None) -> tuple[list[tuple[str, bool]], list[int]]:
    """Lines in order without headings, page lines and leaders, and which of them look like advertisements."""
    kept = [(t, s) for t, s in lines_in_order(text, x0, x1) if "...." not in t and (_SMALL.search(t) or (len(t) < 8 and t[0].islower()))]
    ends = list(accumulate(len(t) + 1 for t, _ in kept))
    return kept, sorted({bisect_right(ends, m.start()) for m in _LOOKS.finditer("\n".join(t for t, _ in kept))})


def samples(text: str, x0: np.ndarray | None = None, x1: np.ndarray | None = None) -> tuple[list[str], list[str]]:
    """Lines to learn from: those that surely look like advertisements, with the short line that ends one, and those far from any."""
    lines, looks = body_lines(text, x0, x1)
    alike = {i for i in looks} | {i + 1 for i in looks if i + 1 < len(lines) and not lines[i][1] and lines[i + 1][1]}
    near = {i + d for i in looks for d in range(-2, TAIL + 1)}
    return [lines[i][0] for i in sorted(alike)], [t for i, (t, _) in enumerate(lines) if i not in near]


def prose_lines(text: str, lexicon: Lexicon, x0: np.ndarray | None = None, x1: np.ndarray | None = None) -> list[str]:
    """The lines that belong to articles."""
    lines, looks = body_lines(text, x0, x1)
    out: set[int] = set()
    for i in looks:
        if lexicon.advert(lines[i][0]) < ALIKE:
            continue
        out.add(i)
        if i and not lines[i - 1][1] and lexicon.advert(lines[i - 1][0]) > BEFORE:
            out.add(i - 1)
        for j in range(i + 1, min(i + 1 + TAIL, len(lines))):
            if lines[j - 1][1] or lexicon.advert(lines[j][0]) < (SHORT_AFTER if lines[j][1] else AFTER):
                break
            out.add(j)
    return [t for i, (t, _) in enumerate(lines) if i not in out] if out else [t for t, _ in lines]


def measure(text: str | None, lexicon: Lexicon, x0: np.ndarray | None = None, x1: np.ndarray | None = None) -> tuple[list[float], float, float, float] | None:
    """``(features, words, english, legible)`` of a page's prose; None where there is none at all.

    ``english`` is the mean log-odds of the known words for English, ``legible`` the share of characters that are letters
    among those that are not blank.
    """
    if not text:
        return None
    body = _BREAK.sub("", "\n".join(prose_lines(text, lexicon, x0, x1)))
    words = _WORD.findall(body.lower())
    n = len(words)
    if n < 5:
        return None
    sylls, letters, long_, hard, easy, joins, known, english, rarity = lexicon.sums(words)
    told = known or 1
    ends = max(1, len(_END.findall(body)))
    per = min(n / ends, 60.0)
    features = [per, log(per), sylls / n, letters / n, long_ / n, hard / n, easy / n, body.count(",") / n, joins / n, (body.count(";") + body.count(":")) / ends, rarity / told]
    return features, float(n), english / told, letters / max(1, len(body) - body.count(" ") - body.count("\n"))
