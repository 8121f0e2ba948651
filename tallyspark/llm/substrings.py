"""Passages that repeat across a corpus, found with suffix automata of reference shards and removed.

A window is LENGTH consecutive words of one document. Every word covered by a window whose word sequence also starts
elsewhere (in another document or in the same one) is removed, at all its places.

1. Anchors. Of the ten-word grams in a window, the one with the smallest hash is the window's anchor; equal windows have
   equal anchors at equal places, so only places with equal anchors need to be compared. An anchor's context spans the
   windows it is the anchor of; each window of a document lies in exactly one context. Anchors that occur once in the
   corpus are dropped by a count over all documents.
2. Reference shards. The distinct contexts of the other anchors, with their numbers of occurrences, are dealt out by
   anchor into shards of about SHARD words. Each shard gets a suffix automaton over the words themselves, whose states
   know how often their strings occur; its contexts are streamed for matching statistics: at each word, the longest
   match that occurs twice or more. Matches of LENGTH words or more are spans to remove. The shards grow in number with
   the corpus, so each automaton stays in the task that reads the contexts dealt to it, instead of going to every
   executor. A context that occurs several times matches as a whole, and its span goes to all its occurrences.
3. An anchor with more than CROWD distinct contexts would fill shards by itself and can't be cut, as any two of its
   contexts may share a window. Its windows are counted one by one, by 128 bits of hash and with partial sums before the
   shuffle, which gives the same spans.

Texts are known by 128 bits of their SHA-256. Contexts are folded by 128 bits (anchor and context) of hashes in which
each place of a sequence has a multiplier of its own; two given sequences share them with probability 2**-128.

Defined cases: null, empty and short texts have no windows; repeated rows repeat each other; of grams that tie for the
anchor the first in the window holds; very long texts are cut into contexts in blocks; an empty table gives no rows; other columns, whatever their names,
play no part; the digest of a text without kept words is that of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, joined, quoted, scratch
from .wordhash import BASE, Words, buffers, constants, content_keys, grams, mix, tidy

LENGTH, GRAM = 35, 10
SHARD, CROWD = 60_000, 4000
#: Contexts hashed at a time.
BLOCK = 8192


def spans_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the word sequences h[start:end], none of them empty: sums of word hashes times odd numbers by place."""
    out = np.empty(len(starts), dtype=np.uint64)
    length = ends - starts
    keys = constants(int(length.max(initial=0)), seed)
    with np.errstate(over="ignore"):
        for at in range(0, len(starts), BLOCK):
            n = length[at : at + BLOCK]
            begin = np.cumsum(n) - n
            place = np.arange(begin[-1] + n[-1]) - np.repeat(begin, n)
            terms = h[np.repeat(starts[at : at + BLOCK], n) + place] * keys[place]
            out[at : at + BLOCK] = mix(np.add.reduceat(terms, begin) ^ n.astype(np.uint64) * np.uint64(BASE))
    return out


def anchors(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of words h of documents text: (document, first word, end, place, anchor hash) of each context. Words count from
    the first of h."""
    last = len(h) - LENGTH + 1
    if last <= 0:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4)) + (np.empty(0, dtype=np.uint64),)
    g = grams(h, GRAM, 23)
    reach, place = LENGTH - GRAM + 1, np.uint64((1 << 28) - 1)
    least = (g & ~place) | np.arange(len(g), dtype=np.uint64)  # ties go to the first place
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])[:last]
    whole = text[:last] == text[LENGTH - 1 :]
    at = (least & place).astype(np.int64)
    s = np.flatnonzero(whole)
    if not len(s):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4)) + (np.empty(0, dtype=np.uint64),)
    # A document's windows follow each other without a gap; a context ends where the anchor's place changes.
    new = np.flatnonzero(np.r_[True, (at[s[1:]] != at[s[:-1]]) | (s[1:] != s[:-1] + 1)])
    first = s[new]
    end = s[np.r_[new[1:], len(s)] - 1] + LENGTH
    return text[first], first, end, at[first], g[at[first]]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> a row for each context: the text's key, anchor, context hash, start, end."""
    split = Words()
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for i, j, text, _, _, h in split.pieces(data, offsets):
            doc, first, end, at, g = anchors(h, text)
            if not len(doc):
                continue
            base = np.searchsorted(text, np.arange(i, j))[doc - i]
            context = spans_hash(h, first, end, 31) + (at - first).astype(np.uint64)
            key = content_keys(data, offsets[i : j + 1])[doc - i]
            for k in range(0, len(doc), BLOCK):
                columns = (key[:, 0], key[:, 1], g.view(np.int64), context.view(np.int64), first - base, end - base)
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BLOCK]) for x in columns], ["hi", "lo", "anchor", "context", "s", "e"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, text, hi, lo)."""
    for batch in batches:
        key = content_keys(*buffers(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key[:, 0]), pa.array(key[:, 1])], ["id", "text", "hi", "lo"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, text, open) -> a row for each context in open, with its bytes."""
    split = Words()
    for batch in batches:
        lists = batch.column(3)
        at, every = lists.offsets.to_numpy(), lists.values
        start, end = every.field("s").to_numpy(), every.field("e").to_numpy()
        data, offsets = buffers(batch.column(2))
        for i, j, text, s, e, _ in split.pieces(data, offsets):
            word = np.searchsorted(text, np.arange(i, j))
            for lo in range(int(at[i]), int(at[j]), BLOCK):
                hi = min(lo + BLOCK, int(at[j]))
                row = np.searchsorted(at, np.arange(lo, hi), "right") - 1
                first, last = s[word[row - i] + start[lo:hi]], e[word[row - i] + end[lo:hi] - 1]
                part, take = every.slice(lo, hi - lo), pa.array(row)
                words = pa.array([data[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
                columns = [part.field("anchor"), part.field("context"), part.field("times"), batch.column(0).take(take), batch.column(1).take(take), part.field("s"), words]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "context", "times", "hi", "lo", "s", "words"])


class SuffixAutomaton:
    """Of several sequences of numbers, each with a number of occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.times = [-1], [0], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.times.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, seq: list[int], times: int) -> list[int]:
        """Adds a sequence; the states of its prefixes."""
        last, states = 0, []
        for c in seq:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            self.times[last] += times
            states.append(last)
        return states

    def settle(self) -> list[int]:
        """Counts every state's occurrences; returns, for each state, the longest length of a suffix of its strings that occurs twice or more."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for v in order:
            if self.link[v] > 0:
                self.times[self.link[v]] += self.times[v]
        best = [0] * len(self.next)
        for v in reversed(order):
            best[v] = self.length[v] if self.times[v] >= 2 else best[self.link[v]]
        return best


def repeated_spans(contexts: list[tuple[list[int], int]], wanted: list[bool], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each wanted context (numbers, occurrences) the merged spans of its matches of `length` or more words that
    occur twice or more among all contexts."""
    automaton = SuffixAutomaton()
    states = [automaton.add(seq, times) for seq, times in contexts]
    best = automaton.settle()
    out = []
    for path, want in zip(states, wanted, strict=True):
        spans: list[tuple[int, int]] = []
        for i, v in enumerate(path) if want else ():
            m = min(best[v], i + 1)
            if m >= length:
                if spans and i + 1 - m <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], i + 1 - m), i + 1)
                else:
                    spans.append((i + 1 - m, i + 1))
        out.append(spans)
    return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, context, times, hi, lo, s, words) sorted by anchor -> (anchor, context, times, hi, lo, s, e): a span
    of the context's first occurrence, the whole of it where it occurs several times."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        contexts, number, anchor = [], {}, None
        count = 0
        for r in rows:
            if r[0] != anchor:  # contexts of different anchors have nothing to do with each other
                count, anchor, number = count + len(number), r[0], {}
            contexts.append(([count + number.setdefault(w, len(number)) for w in r[6].split()], r[2]))
        found = repeated_spans(contexts, [True] * len(rows))
        out = [(*r[:5], r[5] + a, r[5] + b) for r, spans in zip(rows, found, strict=True) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(7)], ["anchor", "context", "times", "hi", "lo", "s", "e"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD and r[0] != rows[-1][0]:
                yield shard(rows)
                rows, size = [], 0
            rows.append(r)
            size += r[6].count(b" ") + 1
    if rows:
        yield shard(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, context, times, hi, lo, s, words) -> a row for each window: hashes, times, text's key, start."""
    split = Words()
    for batch in batches:
        for i, j, text, _, _, h in split.pieces(*buffers(batch.column(6))):
            cut = np.searchsorted(text, np.arange(i, j + 1))
            many = np.maximum(np.diff(cut) - LENGTH + 1, 0)
            row = np.repeat(np.arange(i, j), many)
            off = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            a = cut[row - i] + off
            for k in range(0, len(row), BLOCK):
                part, take = a[k : k + BLOCK], pa.array(row[k : k + BLOCK])
                x, y = (pa.array(spans_hash(h, part, part + LENGTH, seed).view(np.int64)) for seed in (51, 53))
                same = [batch.column(c).take(take) for c in ("anchor", "times", "hi", "lo")]
                first = batch.column("s").take(take).to_numpy() + off[k : k + BLOCK]
                yield pa.RecordBatch.from_arrays([x, y, *same, pa.array(first)], ["x", "y", "anchor", "times", "hi", "lo", "s"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) -> (id, n_words, n_removed, kept_sha256, spans)."""
    split = Words()
    for batch in batches:
        n = len(batch)
        words, removed, digest = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [""] * n
        data, at = buffers(batch.column(1))
        spans = batch.column(2).to_pylist()
        merged: list[list[dict]] = [[] for _ in range(n)]
        for i, j, text, s, e, h in split.pieces(data, at):
            cut = np.searchsorted(text, np.arange(i, j + 1))
            for k in range(i, j):
                a, b = int(cut[k - i]), int(cut[k - i + 1])
                keep, out, done = hashlib.sha256(), merged[k], 0
                for x, y in sorted((z["s"], z["e"]) for z in spans[k] or ()):
                    if out and x <= out[-1]["e"]:
                        out[-1]["e"] = max(out[-1]["e"], y)
                    else:
                        out.append({"s": x, "e": y})
                begun = False
                for x, y in [(z["s"], z["e"]) for z in out] + [(b - a, b - a)]:
                    if x > done:
                        whole = data[s[a + done] : e[a + x - 1]].tobytes()
                        keep.update((b" " if begun else b"") + b" ".join(whole.split()))
                        begun = True
                    removed[k] += y - max(x, done)
                    done = max(done, y)
                words[k], digest[k] = b - a, keep.hexdigest()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(removed), pa.array(digest), pa.array(merged, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], ["id", "n_words", "n_removed", "kept_sha256", "spans"])


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans), one row for each row of docs; spans (s, e) are of words."""
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    places = plain.select("text").where("text is not null").mapInArrow(lambda b: tidy(_documents(b)), "hi long, lo long, anchor long, context long, s long, e long")
    keyed = plain.mapInArrow(_keyed, f"id {kind}, text string, hi long, lo long")
    fetched = "anchor long, context long, times long, hi long, lo long, s long, words binary"
    with scratch(spark) as s:
        shared = s.save(places.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"))
        occurs = s.save(joined(places, shared, ["anchor"], "inner"))
        contexts = s.save(occurs.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min(F.struct("hi", "lo", "s", "e")).alias("one")))
        crowded = s.save(contexts.groupBy("anchor").agg(F.count("*").alias("contexts")).where(F.col("contexts") > CROWD).select("anchor"))

        # The words of each distinct context, from the text it was first seen in.
        asked = s.save(contexts.groupBy("one.hi", "one.lo").agg(F.collect_list(F.struct("anchor", "context", "times", F.col("one.s").alias("s"), F.col("one.e").alias("e"))).alias("open")))
        texts = joined(keyed, asked.select("hi", "lo"), ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.any_value("text").alias("text"))
        words = s.save(joined(texts, asked, ["hi", "lo"], "inner").select("hi", "lo", "text", "open").mapInArrow(lambda b: tidy(_fetch(b)), fetched))

        usual = joined(words, crowded, ["anchor"], "left_anti").select(words.columns)
        matched = s.save(usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: tidy(_match(b)), "anchor long, context long, times long, hi long, lo long, s long, e long"))
        own = matched.where("times = 1").select("hi", "lo", "s", "e")
        whole = matched.where("times > 1").select("anchor", "context")

        crowd = joined(words, crowded, ["anchor"], "inner").select(words.columns)
        each = crowd.mapInArrow(_windows, "x long, y long, anchor long, times long, hi long, lo long, s long")
        twice = each.groupBy("anchor", "x", "y").agg(F.sum("times").alias("all")).where(F.col("all") > 1)
        counted = each.where("times = 1").join(twice, ["anchor", "x", "y"], "left_semi").select("hi", "lo", "s", (F.col("s") + LENGTH).alias("e"))
        whole = whole.unionByName(crowd.where("times > 1").select("anchor", "context"))

        everywhere = occurs.join(whole, ["anchor", "context"], "left_semi").select("hi", "lo", "s", "e").distinct()
        spans = s.save(own.unionByName(everywhere).unionByName(counted).groupBy("hi", "lo").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
        out = joined(keyed, spans, ["hi", "lo"], "left").select("id", "text", "spans")
        return s.keep(out.mapInArrow(lambda b: tidy(_cut(b)), f"id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<s:long,e:long>>"))
