"""Periodic runs of words: stretches that repeat one sequence of words, from boilerplate to decoding loops.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends with that period. By the
runs theorem each run holds a Lyndon root: a place i from which, under an order of the words or under its reverse, the
longest Lyndon word is one period of the run. That word ends where the next smaller suffix begins, which a stack finds
while the words are scanned from right to left. Two suffixes are compared by their longest common extension (LCE): a
binary search over rolling hashes, whose result is then held against the words themselves. What has been verified
at a distance d, words x and x + d being equal for x in an interval, is kept, so that neighbouring places extend it by
one word; the hashes are asked where no interval is known, and hash collisions can't change a result.

A word of a run of exponent e or more occurs e times or more, so rarer words cut a text into pieces, and each piece is
scanned by itself. Nothing else is skipped.

Defined cases: null texts, empty ones and such without words have no runs, and their collapsed text is empty; a null id is an id
like others; repeated rows are judged one by one; very long texts are scanned whole, as one row in one
task; of runs with equal exponents the first, then the one of smaller period is the greatest; an empty table gives no
rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted
from .wordhash import constants, mix, tidy

EXPONENT, LENGTH = 4, 6
NEAR = 4096
BASE = int(constants(1, 29)[0])


class Extensions:
    """LCE queries over numbered words, forward and backward."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.array = np.array(words, dtype=np.int64)
        self.known: dict[int, tuple[int, int]] = {}  # by distance: words [lo, hi) equal those at that distance, and word hi doesn't
        self.sums = None

    def _hashes(self) -> None:
        with np.errstate(over="ignore"):
            powers = np.full(self.n + 1, BASE, dtype=np.uint64)
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            terms = mix(self.array.astype(np.uint64) + np.uint64(1)) * powers[:-1]
        self.sums, self.powers = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]), powers

    def _alike(self, i: int, j: int, size: int) -> bool:
        """Whether words [i, i + size) and [j, j + size), i < j, have equal hashes."""
        s, mask = self.sums, (1 << 64) - 1
        a, b = int(s[i + size]) - int(s[i]), int(s[j + size]) - int(s[j])
        return (a * int(self.powers[j - i]) - b) & mask == 0

    def _search(self, alike, most: int) -> int:
        """The greatest size up to most for which alike holds, if it holds for all smaller ones."""
        lo, hi = 0, 1
        while hi <= most and alike(hi):
            lo, hi = hi, 2 * hi
        hi = min(hi, most + 1)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if alike(mid) else (lo, mid)
        return lo

    def forward(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        w, n, d = self.words, self.n, j - i
        lo, hi = self.known.get(d, (n, n))
        if lo <= i <= hi:
            return hi - i
        if i + 1 == lo and w[i] == w[j]:
            self.known[d] = i, hi
            return hi - i
        for size in range(8):  # most differ at once
            if j + size == n or w[i + size] != w[j + size]:
                self.known[d] = i, i + size
                return size
        if i < lo <= i + NEAR and lo < n:  # what is known begins nearby
            other = np.flatnonzero(self.array[i:lo] != self.array[j : lo + d])
            self.known[d] = i, i + int(other[0]) if len(other) else hi
            return self.known[d][1] - i
        if self.sums is None:
            self._hashes()
        size = self._search(lambda m: self._alike(i, j, m), n - j)
        at = i
        while at < i + size:  # verified word by word, in blocks that leave out what is known
            if lo <= at < hi:
                at = min(hi, i + size)
                continue
            end = min(i + size, at + NEAR, lo if at < lo else n)
            other = np.flatnonzero(self.array[at:end] != self.array[at + d : end + d])
            if len(other):  # equal hashes of different words
                size = at + int(other[0]) - i
                break
            at = end
        while j + size < n and w[i + size] == w[j + size]:  # different hashes say the truth, but a shorter pair that fails may hide a longer one
            size += 1
        self.known[d] = i, i + size
        return size

    def backward(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        if self.sums is None:
            self._hashes()
        size = self._search(lambda m: self._alike(i - m, j - m, m), i)
        other = np.flatnonzero(self.array[i - size : i] != self.array[j - size : j])
        if len(other):
            size -= int(other[-1]) + 1
        while size < i and self.words[i - size - 1] == self.words[j - size - 1]:
            size += 1
        return size


def roots(words: list[int], ext: Extensions, least: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, LCE) for places i whose longest Lyndon word ends before j and is followed by least - 2 repeats of itself or more."""
    n = len(words)
    after = [0] * n
    for i in range(n - 1, -1, -1):
        x, j = words[i], i + 1
        while j < n:
            y = words[j]
            if y < x:
                break
            if y == x:
                size = ext.forward(i, j)
                if j + size == n or words[j + size] < words[i + size]:
                    if size > (least - 2) * (j - i):
                        yield i, j, size
                    break
            j = after[j]
        after[i] = j


def runs_of(words: list[int], exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least so many words and exponent times their period, by start, then period."""
    if len(words) < max(length, exponent):
        return []
    out, ext = set(), Extensions(words)
    last = max(words)
    for order in (words, [last - x for x in words]):
        done: dict[int, int] = {}  # by period: where the run found last starts; a scan from the right meets it again and again
        for i, j, size in roots(order, ext, exponent):
            p = j - i
            if done.get(p, len(words)) <= i:
                continue
            start = i - ext.backward(i, j)
            done[p] = start
            if j + size - start >= max(length, exponent * p):
                out.add((start, j + size - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_runs(words: list[bytes], exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """The runs of a text's words, piece by piece between words that are too rare for a run."""
    if len(words) < max(length, exponent):
        return []
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    often = np.bincount(ids)[ids] >= exponent
    edges = np.flatnonzero(np.diff(often.astype(np.int8), prepend=0, append=0))
    out = []
    for a, b in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2))[:, 0] >= max(length, exponent)].tolist():
        out += [(a + s, n, p) for s, n, p in runs_of(ids[a:b].tolist(), exponent, length)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


def _scan(exponent: int, length: int, texts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(8 if texts else 7)]
        for text in batch.column(1):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # at the ASCII blanks, and at nothing else
            runs = text_runs(words, exponent, length)
            best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
            kept = b" ".join(collapsed(words, runs))
            milli = 1000 * best[1] // best[2] if runs else None
            row = [len(runs), *best, milli, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
            for column, value in zip(columns, [*row, kept.decode("utf-8", "replace")] if texts else row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.string()] * (3 if texts else 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=NAMES + ["collapsed"] * texts)


NAMES = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed) for each row of docs: the
    number of runs, the one of greatest exponent, digests of all runs and of the text without their repeats, and, if
    texts is set, that text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + ", collapsed string" * texts
    narrow = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(lambda batches: tidy(_scan(exponent, length, texts, batches)), schema)
