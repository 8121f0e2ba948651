"""Vectorised words of Arrow string columns: byte ranges and 64-bit hashes, a quarter of a megabyte at a time.

A word is a maximal run of bytes that are no separators. Separators are ASCII, so UTF-8 bytes can be cut at them.
The hash of a word is a sum over its bytes, modulo 2**64, of a number for the byte value times a number for its place
in the word, finished by a bijective mixer. Places have numbers of their own, so no arrangement of bytes (as there is
for polynomials modulo 2**64) makes two words equal by rule; words of over LONG bytes get 64 bits of BLAKE2b. Two given
words share a hash with a probability of about 2**-64: among 10**9 distinct words, any two with one of 3 %.
The hash depends on the bytes and on nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK, LONG = 1 << 18, 4096
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1

#: Bytes that separate words.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that follow from the seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed & MASK)) | np.uint64(1)


class Words:
    """Splits and hashes words. blanks: the separators; lower: A-Z count as a-z."""

    def __init__(self, blanks: bytes = BLANKS, lower: bool = False):
        fold = np.arange(256, dtype=np.uint8)
        if lower:
            fold[65:91] += 32
        inside = np.ones(256, dtype=bool)
        inside[list(blanks)] = False
        self.fold, self.inside = fold, inside[fold]
        self.values, self.places = np.where(self.inside, constants(256, 7)[fold], np.uint64(0)), constants(LONG, 13)

    def _long(self, word: np.ndarray) -> int:
        digest = hashlib.blake2b(digest_size=8)
        for at in range(0, len(word), CHUNK):
            digest.update(self.fold[word[at : at + CHUNK]].tobytes())
        return int.from_bytes(digest.digest(), "little")

    def _piece(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words in data; edges: offsets where a word ends in any case."""
        n = len(data)
        inside = self.inside[data]
        if not inside.any():
            none = np.empty(0, dtype=np.int64)
            return none, none, np.empty(0, dtype=np.uint64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        length = ends - starts
        place = np.zeros(n, dtype=np.int32)
        place[starts] = starts
        place = np.minimum(np.arange(n, dtype=np.int32) - np.maximum.accumulate(place), LONG - 1)
        with np.errstate(over="ignore"):
            terms = self.values[data]  # 0 between words
            terms *= self.places[place]
            h = mix(np.add.reduceat(terms, starts) ^ length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in np.flatnonzero(length > LONG):
            h[k] = self._long(data[starts[k] : ends[k]])
        return starts, ends, h

    def _next(self, data: np.ndarray, at: int, end: int, inside: bool) -> int:
        """The first place from `at` whose byte is inside a word, or is not; end if there is none."""
        while at < end:
            found = np.flatnonzero(self.inside[data[at : min(end, at + CHUNK)]] == inside)
            if len(found):
                return at + int(found[0])
            at += CHUNK
        return end

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of consecutive texts data[offsets[i]:offsets[i + 1]], blocks of whole texts of about CHUNK bytes:
        (first text, text after the last, text of each word, starts, ends, hashes)."""
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            j = min(j, n)
            lo, hi = int(offsets[i]), int(offsets[j])
            if hi - lo <= 2 * CHUNK:
                s, e, h = self._piece(data[lo:hi], np.asarray(offsets[i : j + 1] - lo))
            else:  # one very long text, cut at separators
                parts, at = [], lo
                while at < hi:
                    at = self._next(data, at, hi, True)
                    cut = self._next(data, at, hi, False)
                    if cut - at > CHUNK:  # a word by itself
                        parts.append((np.array([at - lo]), np.array([cut - lo]), np.array([self._long(data[at:cut])], dtype=np.uint64)))
                    else:
                        cut = min(hi, at + CHUNK)
                        if cut < hi and self.inside[data[cut]]:  # not within a word
                            cut = at + 1 + int(np.flatnonzero(~self.inside[data[at:cut]])[-1])
                        a, b, c = self._piece(data[at:cut], np.empty(0, dtype=np.int64))
                        parts.append((a + (at - lo), b + (at - lo), c))
                    at = cut
                s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            s, e = s + lo, e + lo
            text = np.searchsorted(offsets, s, "right") - 1 if j - i > 1 else np.full(len(s), i, dtype=np.int64)
            yield i, j, text, s, e, h
            i = j


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)), at


def content_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text two 64-bit numbers, the first half of its SHA-256."""
    out = np.empty((len(offsets) - 1, 2), dtype=np.int64)
    for k in range(len(out)):
        out[k] = np.frombuffer(hashlib.sha256(data[offsets[k] : offsets[k + 1]]).digest()[:16], dtype=np.int64)
    return out


def give_back() -> None:
    """Returns memory that this process has used and no longer needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, after which the worker gives memory back: Spark keeps it for later tasks."""
    try:
        yield from batches
    finally:
        give_back()


def grams(h: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Hashes of the n-word sequences that start at each word; the last n - 1 words start none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(m, n, dtype=np.uint64)
        for j, c in enumerate(constants(n, seed)):
            out += h[j : j + m] * c
        return mix(out)
