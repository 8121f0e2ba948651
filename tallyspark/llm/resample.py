"""Importance resampling towards a target's distribution of hashed word sequences.

The features of a text are its sequences of one to three words, hashed into BUCKETS buckets by CRC-32. A bucket's gain is the
logarithm of how much likelier the target's features fall into it than the corpus's; a document's weight is the sum of its
features' gains, and adding Gumbel noise to it and taking the highest sums samples without replacement in proportion to exp(weight).

Each partition keeps a trie of words. A node is a sequence: it holds the CRC-32 state of its bytes, so a child's
state takes its own word only, and the number of features that end in it. Tries are merged as totals of buckets, which
have a fixed size whatever the corpus. Documents are then scored along the paths of such tries, with each bucket's gain
attached to the nodes. A trie grows with the texts, so it is begun anew after every BLOCK bytes of them.

Defined cases: null texts, empty ones and such without words have no features and weight 0; a null id counts as the text "" when
noise is drawn; repeated rows are scored and drawn one by one; rows of equal score and id are ranked in any order, as
nothing but their number of features tells them apart; a text of more than BLOCK bytes is read in pieces that share two
words; an empty corpus gives no rows and an empty target is one without features; other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, quoted, scratch
from .wordhash import NOT_ALNUM, tidy

BUCKETS, ORDER, BLOCK = 10_000, 3, 4 << 20
MIN_WORDS, SHARE, SEED = 20, 5, 42
#: A-Z as a-z, and everything between words as a blank.
FOLD = bytes(32 if b in NOT_ALNUM and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else b for b in range(256))
AHEAD = re.compile(rb" *([^ ]+)?(?: +([^ ]+))?")
SHORT = 64


@functools.cache
def appended(sizes: int) -> np.ndarray:
    """By size and byte of a state: what the state becomes when so many zero bytes follow, before their own checksum is added."""
    out = np.zeros((sizes, 4, 256), dtype=np.uint32)
    for n in range(sizes):
        zeros = bytes(n)
        bare = zlib.crc32(zeros)
        for k in range(4):
            out[n, k] = [zlib.crc32(zeros, b << 8 * k) ^ bare for b in range(256)]
    return out


class Vocabulary:
    """Numbers of words, with the checksum of each, the checksum of a blank and the word, and that one's length."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.table = appended(SHORT)
        self.first, self.tail, self.size = (np.empty(0, dtype=t) for t in (np.uint32, np.uint32, np.int64))
        self.long: dict[int, bytes] = {}

    def numbered(self, words: list[bytes]) -> np.ndarray:
        numbers, known = self.numbers, len(self.first)
        new = [w for w in dict.fromkeys(words) if w not in numbers]
        numbers.update(zip(new, range(known, known + len(new)), strict=True))
        if new:
            grown = lambda a, values: np.concatenate([a, np.array(values, dtype=a.dtype)])
            self.first, self.tail = grown(self.first, [zlib.crc32(w) for w in new]), grown(self.tail, [zlib.crc32(b" " + w) for w in new])
            self.size = grown(self.size, [len(w) + 1 for w in new])
            self.long |= {known + k: w for k, w in enumerate(new) if len(w) + 1 >= SHORT}
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))

    def extended(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states after a blank and a word each."""
        size, table = self.size[words], self.table
        short = np.minimum(size, SHORT - 1)
        out = self.tail[words]
        for k in range(4):
            out = out ^ table[short, k, (states >> np.uint32(8 * k)) & np.uint32(255)]
        for k in np.flatnonzero(size >= SHORT):
            out[k] = zlib.crc32(b" " + self.long[int(words[k])], int(states[k]))
        return out


class Trie:
    """The trie of a block of texts. words: their numbers in order; follow: how many words of its own text follow each word (at
    most ORDER - 1 matter). Each depth has nodes with CRC states, counts of the features that end in them, and the node each place comes to."""

    def __init__(self, words: np.ndarray, follow: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary):
        self.depths: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        at, path, states = np.flatnonzero(starts), words, None
        for depth in range(ORDER):
            at = at[follow[at] >= depth]
            if depth == 0:
                nodes, where, counts = np.unique(words[at], return_inverse=True, return_counts=True)
                states = vocabulary.first[nodes]
            else:
                nodes, where, counts = np.unique(path[at] << 32 | words[at + depth], return_inverse=True, return_counts=True)
                states = vocabulary.extended(states[nodes >> 32], nodes & 0xFFFFFFFF)
            path = np.zeros(len(words), dtype=np.int64)
            path[at] = where
            self.depths.append((states, counts, at, where))

    def totals(self, buckets: int) -> np.ndarray:
        """Features by bucket."""
        return sum(np.bincount(states % np.uint32(buckets), weights=counts, minlength=buckets) for states, counts, _, _ in self.depths).astype(np.int64)

    def gained(self, gains: np.ndarray, size: int) -> np.ndarray:
        """For each place the gains of the nodes on the path that starts there."""
        out = np.zeros(size, dtype=np.int64)
        for states, _, at, where in self.depths:
            out[at] += gains[states % np.uint32(len(gains))][where]
        return out


def pieces(data: bytes) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them start features) for a folded text: its words, BLOCK bytes at a time, with the two that follow."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK) if at + BLOCK < len(data) else -1
        if end < 0:
            words = data[at:].split()
            yield words, len(words)
            return
        words = data[at:end].split()
        yield words + [w for w in AHEAD.match(data, end).groups() if w], len(words)
        at = end


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """(words, [(row, words that start features, words)]) for about BLOCK bytes of the batch's texts at a time."""
    words, parts, held = [], [], 0
    for row, text in enumerate(batch.column(1)):
        for part, n in pieces(text.as_buffer().to_pybytes().translate(FOLD)) if text.is_valid else ():
            words += part
            parts.append((row, n, len(part)))
            held += sum(map(len, part)) + len(part)
            if held >= BLOCK:
                yield words, parts
                words, parts, held = [], [], 0
    if parts:
        yield words, parts


def tries(batch: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[tuple[Trie, np.ndarray, np.ndarray, np.ndarray]]:
    """(trie, row of each place, whether features start there, words of its text that follow) for each block."""
    for words, parts in blocks(batch):
        rows, starting, sizes = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts, follow = place < np.repeat(starting, sizes), np.repeat(sizes, sizes) - 1 - place
        yield Trie(vocabulary.numbered(words), follow, starts, vocabulary), np.repeat(rows, sizes), starts, follow


def _counted(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals, vocabulary = np.zeros(buckets, dtype=np.int64), Vocabulary()
    for batch in batches:
        for trie, *_ in tries(batch, vocabulary):
            totals += trie.totals(buckets)
        vocabulary = vocabulary if len(vocabulary.numbers) < 1 << 18 else Vocabulary()
    some = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], names=["bucket", "n"])


def _scored(gains: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary()
    for batch in batches:
        words, features, weights = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
        for trie, rows, starts, follow in tries(batch, vocabulary):
            np.add.at(words, rows, starts)
            np.add.at(features, rows, np.where(starts, np.minimum(follow, ORDER - 1) + 1, 0))
            np.add.at(weights, rows, trie.gained(gains, len(rows)))
        vocabulary = vocabulary if len(vocabulary.numbers) < 1 << 18 else Vocabulary()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weights)], names=["id", "n_words", "n_features", "weight"])


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of the texts fall into each bucket that has any."""
    bounded_batches(texts.sparkSession)
    narrow = texts.select(F.lit(0).alias("id"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(lambda b: tidy(_counted(buckets, b)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain in thousandths. The driver sees two tables of at most so many rows as there are buckets."""
    corpus = feature_counts(docs, text_col, buckets).withColumnRenamed("n", "s")
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(corpus, "bucket", "left").join(feature_counts(target, text_col, buckets).withColumnRenamed("n", "t"), "bucket", "left").fillna(0).select("bucket", "s", "t").collect()
    total = {k: sum(r[k] for r in both) for k in ("s", "t")}
    out = np.zeros(buckets, dtype=np.int64)
    for r in both:
        ratio = (float(r["t"]) + 1) * (float(total["s"]) + buckets) / ((float(r["s"]) + 1) * (float(total["t"]) + buckets))
        out[r["bucket"]] = int(np.floor(1000 * np.log(ratio)))
    return out.tolist()


def noise(id_col: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel variate that follows from seed and id, as a whole number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(s: Scratch, scored: DataFrame, share: int) -> DataFrame:
    """scored(id, ..., score) with `rank` from 1 on by falling score, then id, for the first share per cent of its rows, and null
    for the others. Rows are dealt out by ranges of score and id; a row's number in its range and the sizes of the
    ranges before it, two numbers each, make its rank."""
    dealt = s.save(scored.repartitionByRange(F.col("score").desc(), F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = dealt.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, most = [], sum(r["count"] for r in sizes) * share // 100
    for r in sizes:
        before.append((r["part"], before[-1][1] + before[-1][2] if before else 0, r["count"]))
    offsets = F.broadcast(scored.sparkSession.createDataFrame(before, "part long, offset long, size long"))  # a row for each partition
    rank = F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("part", part).join(offsets, "part", "left").select(*scored.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, min_words: int = MIN_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of docs: rank is null where the row isn't drawn. Of the documents with
    at least min_words words, share per cent are drawn."""
    spark = bounded_batches(docs.sparkSession)
    with scratch(spark) as s:
        gained = np.array(gains(docs, target, text_col, buckets), dtype=np.int64)
        kind = docs.schema[id_col].dataType.simpleString()
        narrow = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
        scored = s.save(narrow.mapInArrow(lambda b: tidy(_scored(gained, b)), f"id {kind}, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
        out = ranked(s, scored.where(F.col("n_words") >= min_words), share).unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
        return s.keep(out.select("id", "n_features", "weight", "score", "rank"))
