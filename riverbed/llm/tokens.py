"""Encoding of whole corpora with a public byte-level BPE vocabulary, by prefix-sharing trie traversal.

A text is split into words by the tokenizer's pattern; each distinct word of a task is encoded once.  The distinct
words form a trie, walked depth first in sorted order.  The state of a node, the last token of the encoding of the
prefix that leads to it, follows from the states above it: it is the token that ends there and goes together with
the last token of the prefix before it.  Words that share a prefix share those states; a word's encoding is read off
backwards along its path.

The vocabulary is a file of fixed size (under 1 MB) that the driver reads and broadcasts; texts never leave their
partition, so there is no shuffle.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files are (a parameter of every operator here).
TOKENIZERS = os.environ.get("RIVERBED_TOKENIZERS", "/opt/tokenizers")

#: The pattern that splits text before merges are applied (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts split at once; words, pairs and nodes of the trie remembered by a worker before it forgets and starts anew.
SLICE, MOST_WORDS, MOST_PAIRS, MOST_NODES = 256, 400_000, 400_000, 1_000_000
#: Bytes of the longest prefixes that stay as nodes.
DEEPEST = 64

#: Characters after which a long text is cut at the next place between two words.
SPAN = 1 << 20
_SEAM = re.compile(r"(?<=\S)[ \n](?=\S)")


#: White space of any kind but blank and line end, and the mark used for cutting.
_ODD = re.compile("[\0\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Where a text may not be cut before every blank and around every line end without changing its words.
_TANGLED = re.compile(r"\s{3}|\n\s|\s\Z|\x00")


def _simple(text: str) -> bool:
    """Whether every run of white space is one blank or one line end."""
    return "  " not in text and " \n" not in text and "\n " not in text and "\n\n" not in text and text[-1] not in " \n" and not _ODD.search(text)


def _spans(text: str) -> Iterator[str]:
    """A long text in spans that begin with a single blank or line end between two words."""
    at = 0
    while len(text) - at > SPAN and (seam := _SEAM.search(text, at + SPAN)):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


class TrieEncoder:
    """Encodes words by a rank table: token bytes to token id, in which a lower id is merged first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.edges: dict[int, dict[int, list[tuple[bytes, float]]]] = {0: {}, -1: {}}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.nodes: dict[bytes, tuple[int, int]] = {}

    def merged(self, word: bytes, most: float = float("inf")) -> list[bytes]:
        """The plain merge loop, with the tokens below ``most`` only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], most)) < most), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at one side (0 left, -1 right) of a token while it is merged, and the merge that ends each."""
        found = self.edges[side].get(token)
        if found is None:
            word = self.tokens[token]
            part = self.merged(word, token)[side] if len(word) > 1 else None
            found = [(word, float("inf"))]
            if part is not None and len(part) < len(word):
                found += [(part, token), *self.edge(self.ranks[part], side)[1:]]
            self.edges[side][token] = found
        return found

    def together(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no merge across the seam comes before those that make a and b.

        Of merges of one rank the left one comes first.
        """
        fits = self.pairs.get((a, b))
        if fits is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            rank, right = self.ranks.get, self.edge(b, 0)
            fits = self.pairs[a, b] = not any((r := rank(x + y)) is not None and r < x_ends and r <= y_ends for x, x_ends in self.edge(a, -1) for y, y_ends in right)
        return fits

    def learn(self, words: Iterable[str]) -> None:
        """Walk the trie of ``words`` depth first and remember their encodings.

        A node is a prefix with its last token and that token's length.  Nodes stay from one call to the next, so a prefix
        that words of other texts share is not computed again.
        """
        ranks, longest, together, nodes = self.ranks, self.longest, self.together, self.nodes
        if len(nodes) > MOST_NODES:
            nodes.clear()
        last, size = [-1], [0]  # by depth: the last token of the prefix and its length
        before = b""
        for word, text in sorted((w.encode("utf-8", "replace"), w) for w in words):
            whole = ranks.get(word)
            if whole is not None:
                self.known[text] = whole.to_bytes(4, "little")
                continue
            depth = len(os.path.commonprefix((before, word)))
            del last[depth + 1 :], size[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                node = nodes.get(word[:end]) if end <= DEEPEST else None
                if node is None:
                    for start in range(max(0, end - longest), end):
                        token = ranks.get(word[start:end])
                        if token is not None and (start == 0 or together(last[start], token)):
                            node = token, end - start
                            if end <= DEEPEST:
                                nodes[word[:end]] = node
                            break
                last.append(node[0])
                size.append(node[1])
            before = word
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[end]
            self.known[text] = np.array(ids[::-1], "<i4").tobytes()

    def chunks(self, text: str) -> list[str]:
        """The text cut into chunks of whole words: cheaply where white space is simple, else into the words."""
        if not _simple(text) and _TANGLED.search(text):
            return self.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text, as 32-bit numbers in a row; none for an empty or null one."""
        return [b"".join(self._encode(list(_spans(t)))) if t and len(t) > SPAN else e for t, e in zip(texts, self._encode([None if t and len(t) > SPAN else t for t in texts]))]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.chunks(t) if t else [] for t in texts]
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        new = set(chain.from_iterable(cut)).difference(self.known)
        if new:
            words = {c: self.split(c) for c in new}
            self.learn(set(chain.from_iterable(words.values())).difference(self.known))
            known = self.known
            known.update({c: b"".join([known[w] for w in ws]) for c, ws in words.items()})
        of = self.known.__getitem__
        return [b"".join(map(of, chunks)) for chunks in cut]


_encoders: dict[tuple[int, str], TrieEncoder] = {}


def _encoder(raw: bytes, pattern: str) -> TrieEncoder:
    key = (hash(raw), pattern)
    if key not in _encoders:
        _encoders[key] = TrieEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}, pattern)
    return _encoders[key]


def _vocabulary(spark: SparkSession, name: str, folder: str | None):
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(raw, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, whose last column is the text, with the token ids of each text."""
    encoder = _encoder(raw.value, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, encoder.encode(part.column(part.num_columns - 1).to_pylist())


def token_ids(df: DataFrame, text: str, keep: list[str], out: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` and ``out``: the token ids of ``text``, without special tokens, one row per row of ``df``.

    An empty text and a null text give an empty list.  Strings of special tokens in a text are ordinary text.  Whole
    texts are encoded, of any length.  Rows are neither joined nor reordered, so repeated rows and clashing names in
    other columns do not matter.
    """
    raw = _vocabulary(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(raw, pattern, batches):
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{schema}, `{out}` array<int>")


def token_counts(df: DataFrame, text: str, keep: list[str], out: str = "tokens", vocabulary: str = "byte_bpe_50k", folder: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` and ``out``: the number of tokens of ``text``, 0 for an empty or null one."""
    raw = _vocabulary(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(raw, pattern, batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(i) // 4 for i in ids], pa.int64())], [*keep, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{schema}, `{out}` long")
