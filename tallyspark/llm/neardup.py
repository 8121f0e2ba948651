"""Near-duplicate documents by MinHash with tensored banding; every link is confirmed on the full sets.

A document's set holds the distinct five-word shingles of its whole text (a shorter text: its whole word sequence). Two
documents are linked if their sets' Jaccard similarity is 0.75 or more; a group is what links connect.

1. One pass over the texts gives each set's size, a 128-bit fingerprint and COLLECTIONS small MinHash collections of
   WIDTH hashes each, so COLLECTIONS * WIDTH hash functions. Equal sets are folded into the smallest id.
2. Tensoring: a table's key combines two of the collections, so 16 collections make 120 tables of four hashes each. At
   similarity 0.75 a pair misses all of them with probability below 4e-5. Collections whose value no other set has are
   left out first: they cannot make a shared key, and most documents have none left.
3. In each bucket all sets are tried against its smallest one: as many pairs as rows, never all pairs.
4. Buckets that still hold several components go to an exact way for the rest: over all sets of such buckets a prefix
   filter (rarest shingles first, with the size and position bounds of Jaccard 0.75) finds every possible link between
   components, and these are confirmed too.

The nodes of the graph are distinct sets, so the ids may be of any type that has an order, and rows that repeat an id
with other texts are linked each by its own text. Shingles are compared by 64-bit hashes (wordhash.py); two sets of a
thousand shingles share one by chance with probability 5e-14.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing. Rows with a null id are linked
with nothing and kept. Of rows that repeat an id each gets the component of its own text, and rows that repeat id and text get
equal results. Very long texts are one set like others; other columns play no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, components, joined, quoted, scratch
from .wordhash import Words, buffers, constants, grams, mix, tidy

COLLECTIONS, WIDTH, SHINGLE = 16, 2, 5
#: A shingle that this many sets share is dealt out in blocks of so many sets.
BLOCK = 4096
#: Pairs that one task confirms for a document.
GROUP = 1000


def sets(column: pa.Array, split: Words) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of each text."""
    data, offsets = buffers(column)
    for i, j, text, _, _, h in split.pieces(data, offsets):
        at = np.searchsorted(text, np.arange(i, j + 1))
        g = grams(h, SHINGLE)
        for k in range(i, j):
            a, b = int(at[k - i]), int(at[k - i + 1])
            yield k, np.unique(g[a : b - SHINGLE + 1]) if b - a >= SHINGLE else grams(h[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, content) -> (id, content, n, hi, lo, sig): size, fingerprint and collections of each set, zeros for an empty one."""
    split, keys, tags = Words(lower=True), constants(COLLECTIONS * WIDTH, 99), constants(COLLECTIONS, 5)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for batch in batches:
        rows = len(batch)
        size, hi, lo, sig = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.uint64), np.zeros((rows, COLLECTIONS), dtype=np.uint64)
        for i, j, text, _, _, h in split.pieces(*buffers(batch.column(1))):
            at = np.searchsorted(text, np.arange(i, j + 1))
            count = np.diff(at)
            full = np.flatnonzero(count)
            if not len(full):
                continue
            g = np.full(len(h), most)
            g[: max(0, len(h) - SHINGLE + 1)] = grams(h, SHINGLE)
            starts = np.arange(len(h))
            beyond = starts + SHINGLE > at[text - i + 1]  # no shingle starts here
            for k in np.flatnonzero((count > 0) & (count < SHINGLE)):
                g[at[k]], beyond[at[k]] = grams(h[at[k] : at[k + 1]], int(count[k]))[0], False
            with np.errstate(over="ignore"):
                for k in full:
                    x = np.unique(g[at[k] : at[k] + max(1, count[k] - SHINGLE + 1)])
                    size[i + k], hi[i + k], lo[i + k] = len(x), mix(x).sum(), mix(x * tags[0]).sum()
                part = np.tile(tags, (len(full), 1))
                v = np.empty_like(g)
                for n, c in enumerate(keys):
                    np.multiply(np.bitwise_xor(g, c, out=v), c, out=v)
                    v[beyond] = most
                    part[:, n // WIDTH] = mix(part[:, n // WIDTH] + np.minimum.reduceat(v, at[full]))
                sig[i + full] = part
        values = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * COLLECTIONS, pa.int32()), pa.array(sig.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), values], ["id", "content", "n", "hi", "lo", "sig"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text) dealt out by a, each a's own text first, with b null -> the pairs (a, b) whose sets are similar enough."""
    split, now, x = Words(lower=True), None, np.empty(0, dtype=np.uint64)
    for batch in batches:
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        left, right = [], []
        for k, y in sets(batch.column(2), split):
            if b[k] is None:
                now, x = a[k], y
                continue
            assert now == a[k]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                left.append(now)
                right.append(b[k])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = Words(lower=True)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for k, x in sets(batch.column(1), split):
            for at in range(0, len(x), 1 << 16):
                part = x[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), ids[k])), pa.array(np.full(len(part), len(x))), pa.array(part.view(np.int64))], ["id", "n", "shingle"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id, n, component, place, side) sorted by cell: the pairs of a cell that lie in different components
    and may be similar enough, by size and by the places of the shared shingle."""

    def pairs(g: dict[str, np.ndarray]) -> pa.RecordBatch:
        i, n, c, p, side = (g[x] for x in ("id", "n", "component", "place", "side"))
        left, right = [], []
        for k in np.flatnonzero(side > 0):
            others = (c != c[k]) & (i > i[k] if side[k] == 2 else side == 0)
            small, big = np.minimum(n, n[k]), np.maximum(n, n[k])
            need = np.ceil(0.75 / 1.75 * (n + n[k]) - 1e-6)
            others &= (4 * small >= 3 * big) & (1 + np.minimum(n - p, n[k] - p[k]) - 1 >= need)
            hit = i[others]
            left.append(np.minimum(hit, i[k]))
            right.append(np.maximum(hit, i[k]))
        x, y = (np.concatenate(z) if z else np.empty(0, dtype=np.int64) for z in (left, right))
        xy = np.unique(np.stack([x, y]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(xy[0]), pa.array(xy[1])], ["a", "b"])

    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        rest = new if rest is None else {k: np.concatenate([rest[k], new[k]]) for k in new}
        cell = rest["cell"]
        cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield pairs({k: v[x:y] for k, v in rest.items()})
        if len(cuts):
            rest = {k: v[cuts[-1] :] for k, v in rest.items()}
    if rest is not None and len(rest["cell"]):
        yield pairs(rest)


def _links(s: Scratch, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough. The texts of all b that an a has go past a's own, which travels once; an a
    with more than GROUP pairs is dealt out in parts."""
    parts = s.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")))
    left = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.select(F.col("id").alias("a"), "text"), "a")
    right = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")).join(texts.select(F.col("id").alias("b"), "text"), "b")
    rows = left.select("a", "part", F.lit(None).cast("long").alias("b"), "text").unionByName(right.select("a", "part", "b", "text"))
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return s.save(dealt.select("a", "b", "text").mapInArrow(lambda b: tidy(_confirm(b)), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_no, content), one row for each row of docs. set_no: a number that the
    documents of a group share, null for empty texts; content: a 64-bit hash of the text, which tells rows of one id apart."""
    spark = bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    with scratch(spark) as s:
        plain = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
        plain = plain.withColumn("content", F.xxhash64("text"))
        signed = s.save(plain.mapInArrow(lambda b: tidy(_sign(b)), f"id {kind}, content long, n long, hi long, lo long, sig array<long>"))
        folded = s.save(signed.where("id is not null and n > 0").groupBy("hi", "lo", "n").agg(F.min(F.struct("id", "content")).alias("one"), F.any_value("sig").alias("sig")))
        # Numbers follow the ids, so that the centre of a bucket is its first document, of which later ones are mostly copies.
        nodes = s.save(folded.orderBy("one").select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "n", F.col("one.id").alias("id"), F.col("one.content").alias("content"), "sig"))

        # A table's key is a pair of collections; those that no other set shares cannot meet anything.
        each = nodes.select("node", "n", F.explode("sig").alias("value"))
        shared = each.groupBy("value").agg(F.count("*").alias("sets")).where("sets > 1").select("value")
        left = each.join(shared, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list("value")).alias("v")).where("size(v) > 1")
        pairs_of = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.xxhash64(x, y))))
        keys = s.save(left.select("node", "n", F.explode(pairs_of).alias("key")))

        # Each bucket's sets against its smallest.
        buckets = s.save(keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("sets")).where("sets > 1"))
        tried = s.save(
            keys.join(buckets, "key")
            .where("node <> least.node and 4 * least(n, least.n) >= 3 * greatest(n, least.n)")
            .select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()
        )
        wanted = s.save(keys.join(buckets.select("key"), "key", "left_semi").select("node").distinct().join(nodes, "node").select("node", "id", "content"))
        found = joined(plain, wanted, ["id", "content"], "inner").select(F.col("node").alias("id"), "text")
        again = signed.where("id is not null").groupBy("id", "content").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count()
        texts = s.save(found.groupBy("id").agg(F.any_value("text").alias("text")) if again else found)
        links = _links(s, tried, texts)
        label = components(s, links)

        # The exact way for buckets that still hold several components.
        member = keys.join(buckets.where("sets > 2").select("key"), "key", "left_semi").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        rest = s.save(member.join(mixed, "key", "left_semi").select(F.col("node").alias("id"), "component").distinct())
        more = _links(s, s.save(_prefix_pairs(s, texts, rest).join(tried, ["a", "b"], "left_anti")), texts)

        final = components(s, links.unionByName(more))
        placed = s.save(nodes.select("node", "hi", "lo", "n", "id").join(final, "node", "left").withColumn("set_no", F.coalesce("component", "node")).drop("component"))
        smallest = placed.groupBy("set_no").agg(F.min("id").alias("component"))
        group = s.save(placed.join(smallest, "set_no").select("hi", "lo", "n", "component", "set_no"))
        out = signed.join(group, ["hi", "lo", "n"], "left")
        component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
        return s.keep(out.select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
            F.when(F.col("id").isNotNull(), F.col("set_no")).alias("set_no"), "content",
        ))


def _prefix_pairs(s: Scratch, texts: DataFrame, rest: DataFrame) -> DataFrame:
    """Pairs (a < b) of rest in different components that may be linked: all such pairs whose similarity is 0.75 or
    more share a shingle among the rarest quarter of either set."""
    tokens = s.save(joined(texts, rest.select("id"), ["id"], "left_semi").select("id", "text").mapInArrow(lambda b: tidy(_shingles(b)), "id long, n long, shingle long"))
    common = tokens.groupBy("shingle").agg(F.count("*").alias("df"))
    # Rarest first; a shingle of one set only takes its place but meets nothing.
    ranked = tokens.join(common, "shingle").groupBy("id", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "shingle"))), F.lit(1), (F.col("n") - F.ceil(0.75 * F.col("n") - 1e-6) + 1).cast("int")).alias("prefix"))
    prefix = ranked.select("id", "n", F.posexplode("prefix").alias("place", "at")).where("at.df > 1").join(rest, "id")
    # Sets that share a common shingle are dealt out as pairs of blocks: each row is at home in its own block's row of cells.
    blocks = F.ceil(F.col("at.df") / BLOCK).cast("int")
    home = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = prefix.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = dealt.select(
        F.xxhash64("at.shingle", F.greatest("home", "other"), F.least("home", "other")).alias("cell"), "id", "n", "component", F.col("place").cast("long").alias("place"),
        F.when(F.col("home") == F.col("other"), 2).when(F.col("home") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    met = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: tidy(_meet(b)), "a long, b long")
    return s.save(met.distinct())
