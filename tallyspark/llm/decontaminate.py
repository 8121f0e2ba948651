"""Benchmark decontamination with an FM-index for each training shard.

Words are compared with A-Z as a-z. A window is 13 consecutive words of a benchmark item, or a whole item of fewer. The
documents of a task make shards of up to SHARD words. A shard's index is the Burrows-Wheeler transform of its word
numbers in a wavelet matrix, with every STEP-th suffix position kept. All windows are searched backwards at once
through the matrix's ranks, their occurrences are located by walking to a kept position, and each document's
occurrences are merged into removal spans of words. What goes into the index are the runs of benchmark words that are at least as long as
the shortest window: no window can occur anywhere else. A word counts as a benchmark word if it shares its 64-bit hash
(wordhash.py): by chance a foreign word does so once in about 10**13 words for a block's vocabulary, and a hit needs a
whole window of them.

The benchmark is the stated query set. It is read in blocks of up to BLOCK_BYTES of text, and each block is broadcast,
as word numbers and places in them, and searched in a pass of its own over the documents.

Defined cases: null texts have no words and are clean; items that are null, wordless or without an id are no items;
an item id that repeats counts once among a document's items; repeated rows are judged one by one; a very long text is searched in parts that overlap by a window; an
empty benchmark leaves everything clean; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, scratch
from .wordhash import NOT_ALNUM, Words, buffers, give_back, grams, mix, tidy

WINDOW = 13
SHARD, STEP, FLUSH = 1 << 18, 8, 5000
BLOCK_BYTES = 4 << 20


class WaveletMatrix:
    """Ranks over a sequence of numbers below 2**bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(seq), bits, []
        for level in range(bits - 1, -1, -1):
            one = (seq >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=bool)
            padded[: self.n] = one
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = self.n - int(before[-1])
            self.levels.append((packed, before, zeros))
            seq = np.concatenate([seq[~one], seq[one]])

    @staticmethod
    def _ones(level: tuple, i: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(packed[i >> 6] & low)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i, for arrays of both."""
        start = np.zeros_like(i)
        for k, level in enumerate(self.levels):
            one = (c >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, i)
            start, i = np.where(one, level[2] + a, start - a), np.where(one, level[2] + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        c = np.zeros_like(i)
        for level in self.levels:
            one = (level[0][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a = self._ones(level, i)
            c, i = c << 1 | one, np.where(one, level[2] + a, i - a)
        return c


def suffixes(seq: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling."""
    rank, k, n = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1, len(seq)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-k or None] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        k *= 2
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class FMIndex:
    """Of a sequence of numbers above 0."""

    def __init__(self, seq: np.ndarray, top: int):
        seq = np.concatenate([seq, [0]]).astype(np.int64)
        order = suffixes(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.bwt = WaveletMatrix(seq[order - 1], max(1, int(top).bit_length()))
        kept = order % STEP == 0
        self.mark = WaveletMatrix(kept.astype(np.int64), 1)
        self.kept, self.places = kept, order[kept]

    def search(self, words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that start with words[start : start + n]."""
        lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.bwt.n, dtype=np.int64)
        live = np.arange(len(starts))
        for j in range(n - 1, -1, -1):
            c = words[starts[live] + j].astype(np.int64)
            lo[live], hi[live] = self.first[c] + self.bwt.rank(c, lo[live]), self.first[c] + self.bwt.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the sequence of suffixes, by steps back to a kept place."""
        out, steps, todo = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            here = self.kept[rows[todo]]
            at = todo[here]
            out[at] = self.places[self.mark.rank(np.ones(len(at), dtype=np.int64), rows[at])] + steps[at]
            todo = todo[~here]
            c = self.bwt.access(rows[todo])
            rows[todo] = self.first[c] + self.bwt.rank(c, rows[todo])
            steps[todo] += 1
        return out


def windows(items: list[tuple[str, str | None]]) -> dict:
    """The distinct windows of (item, text) pairs: vocabulary (sorted hashes; word numbers are 2 and up), the words of all
    items, the items' ids, and for each length (first word of each window, its owners' ends in `owners`, owners)."""
    split = Words(NOT_ALNUM, lower=True)
    names = sorted({i for i, _ in items})
    hashes, ends = [np.empty(0, dtype=np.uint64)], []
    for i, j, text, _, _, h in split.pieces(*buffers(pa.array([t for _, t in items], pa.string()))):
        hashes.append(h)
        ends.append(np.bincount(text - i, minlength=j - i))
    h, count = np.concatenate(hashes), np.concatenate([np.empty(0, dtype=np.int64), *ends])
    vocabulary = np.unique(h)
    words = (np.searchsorted(vocabulary, h) + 2).astype(np.int32)
    first = np.cumsum(count) - count
    number = {name: k for k, name in enumerate(names)}
    owner = np.array([number[i] for i, _ in items], dtype=np.int64)
    found = {}
    for n in np.unique(np.minimum(count, WINDOW)).tolist():
        if not n:
            continue
        own = np.flatnonzero(np.minimum(count, WINDOW) == n)
        many = count[own] - n + 1
        starts = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        of = np.repeat(owner[own], many)
        for seed in range(100):  # until no two different windows share a hash: the first, as a rule
            key = grams(mix(words.astype(np.uint64)), n, seed)[starts]
            _, at, which = np.unique(key, return_index=True, return_inverse=True)
            if all((words[starts + k] == words[starts[at][which] + k]).all() for k in range(n)):
                break
        pairs = np.unique(which.astype(np.int64) * max(1, len(names)) + of)
        found[n] = (starts[at].astype(np.int32), np.searchsorted(pairs // max(1, len(names)), np.arange(len(at)), "right"), (pairs % max(1, len(names))).astype(np.int32))
    return {"vocabulary": vocabulary, "words": words, "names": names, "windows": found}


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by document and place, those that touch made one."""
    if not len(doc):
        return doc, start, end
    far = int(end.max()) + 2
    order = np.lexsort((start, doc))
    a, b = (doc * far + start)[order], np.maximum.accumulate((doc * far + end)[order])
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    last = np.r_[new[1:], len(a)] - 1
    d = doc[order][new]
    return d, a[new] - d * far, b[last] - d * far


def _scan(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (text, ...) -> (..., n_words, starts, ends, items). Texts are let go once their words are numbered: a task holds one batch, what a
    shard needs, and the other columns of FLUSH rows."""
    query = shared.value if hasattr(shared, "value") else shared
    vocabulary, least = query["vocabulary"], min(query["windows"], default=0)
    split = Words(NOT_ALNUM, lower=True)
    rows: list[pa.RecordBatch] = []
    counts: list[np.ndarray] = []
    runs: list[np.ndarray] = []
    where: list[tuple[int, int, int]] = []  # document, its first word in the run, place in the shard
    hits: list[tuple[np.ndarray, ...]] = []  # documents, first words, ends
    items: dict[int, set] = {}
    size = docs = 0

    def search() -> None:
        """Puts what the shard holds into hits and items."""
        nonlocal runs, where, size
        if runs:
            index = FMIndex(np.concatenate(runs), len(vocabulary) + 1)
            doc, word, place = (np.array(x) for x in zip(*where, strict=True))
            for n, (starts, ends, owners) in query["windows"].items():
                lo, hi = index.search(query["words"], starts, n)
                some = np.flatnonzero(hi > lo)
                times = hi[some] - lo[some]
                if not len(some):
                    continue
                which = np.repeat(some, times)
                suffix = np.repeat(lo[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at = index.locate(suffix)
                run = np.searchsorted(place, at, "right") - 1
                first = word[run] + at - place[run]
                hits.append(merged(doc[run], first, first + n))
                for d, w in {*zip(doc[run].tolist(), which.tolist(), strict=True)}:
                    items.setdefault(d, set()).update(query["names"][x] for x in owners[ends[w - 1] if w else 0 : ends[w]].tolist())
        runs, where, size = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal rows, counts, docs, hits, items
        search()
        none = np.empty(0, dtype=np.int64)
        d, s, e = merged(*(np.concatenate(x) for x in zip((none, none, none), *hits, strict=True)))
        cut = pa.array(np.searchsorted(d, np.arange(docs + 1)), pa.int32())
        owned = [sorted(items.get(d, ())) for d in range(docs)]
        table = pa.Table.from_batches(rows).combine_chunks()
        for name, column in (("n_words", pa.array(np.concatenate(counts), pa.int64())), ("starts", pa.ListArray.from_arrays(cut, pa.array(s))), ("ends", pa.ListArray.from_arrays(cut, pa.array(e))), ("items", pa.array(owned, pa.list_(pa.string())))):
            table = table.append_column(name, column)
        yield from table.to_batches()
        rows, counts, hits, items, docs = [], [], [], {}, 0

    for batch in batches:
        for i, j, text, _, _, h in split.pieces(*buffers(batch.column(0))):
            counts.append(np.bincount(text - i, minlength=j - i).astype(np.int64))
            number = np.searchsorted(vocabulary, h)
            known = np.zeros(len(h), dtype=bool)
            if least:
                known = vocabulary[np.minimum(number, len(vocabulary) - 1)] == h
            # Runs of known words within a document; only those in which a window fits.
            edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.empty(0, dtype=np.int64)
            length = np.diff(np.r_[edge, len(h)])
            first = np.searchsorted(text, np.arange(i, j))
            for a, n in zip(edge[known[edge] & (length >= least)].tolist(), length[known[edge] & (length >= least)].tolist(), strict=True):
                for b in range(a, a + n, SHARD):  # parts overlap by a window
                    part = number[b : min(a + n, b + SHARD + WINDOW - 1)] + 2
                    runs.append(np.append(part, 1))
                    where.append((docs + int(text[a]) - i, b - int(first[text[a] - i]), size))
                    size += len(part) + 1
                    if size >= SHARD:
                        search()
            rows.append(batch.slice(i, j - i).select(batch.schema.names[1:]))
            docs += j - i
            if docs >= FLUSH:
                yield from flush()
    if rows:
        yield from flush()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, n_words, starts, ends, items) with spans and items of several passes -> the same with spans merged and items once."""
    for batch in batches:
        starts, ends = batch.column("starts"), batch.column("ends")
        doc = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy()))
        d, s, e = merged(doc, starts.flatten().to_numpy(), ends.flatten().to_numpy())
        cut = pa.array(np.searchsorted(d, np.arange(batch.num_rows + 1)), pa.int32())
        owned = pa.array([sorted(set(x)) for x in batch.column("items").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.ListArray.from_arrays(cut, pa.array(s)), pa.ListArray.from_arrays(cut, pa.array(e)), owned], ["id", "n_words", "starts", "ends", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, starts, ends, items, contaminated): one row for each row of docs; starts and ends bound the merged spans of hit words, items are the
    item ids as strings. A document is contaminated if at least one word in twenty is hit.

    A benchmark of one block is one pass over docs. Of more, each pass by itself has one Python worker for each core and one
    block in it; the first gives all rows, the others save those with hits, which meet by id and a digest of the text."""
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(quoted(item_col)).cast("string").alias("item"), F.col(quoted(item_text_col)).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    text = F.col(quoted(text_col))
    rows = docs.select(text.alias("text"), F.col(quoted(id_col)).alias("id"), *[F.struct(F.col(quoted(id_col)).alias("id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text")).alias("key")] * (blocks > 1))
    schema = f"id {kind}, {f'key struct<id:{kind},text:string>, ' * (blocks > 1)}n_words long, starts array<long>, ends array<long>, items array<string>"

    def searched(k: int) -> DataFrame:
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(windows(sorted((r["item"], r["text"]) for r in block.collect())))  # a block: about BLOCK_BYTES of text
        give_back()
        return rows.mapInArrow(lambda b: tidy(_scan(shared, b)), schema)

    out = searched(0)
    if blocks > 1:
        with scratch(spark) as s:
            first, more = s.save(out), None
            for k in range(1, blocks):
                part = s.save(searched(k).where(F.size("starts") > 0).dropDuplicates(["key"]).drop("id", "n_words"))
                more = part if more is None else more.unionByName(part)
            joined = lambda c: F.flatten(F.collect_list(c)).alias(f"more_{c}")
            more = s.save(more.groupBy("key").agg(*map(joined, ("starts", "ends", "items"))))
            both = first.join(more, first["key"].eqNullSafe(more["key"]), "left")
            listed = [F.concat(c, F.coalesce(f"more_{c}", F.array().cast(first.schema[c].dataType))).alias(c) for c in ("starts", "ends", "items")]
            out = s.keep(both.select("id", "n_words", *listed).mapInArrow(lambda b: tidy(_united(b)), f"id {kind}, n_words long, starts array<long>, ends array<long>, items array<string>"))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda t, x: t + x)
    out = out.withColumn("n_hit", hit)
    return out.select("id", "n_words", "n_hit", "starts", "ends", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
