"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target is its share by weight of the words asked for, at most MOST times what it has; what is cut off there
goes to the others by weight until no target is above (water filling, a sum over the sources for each round).
A source that must give k.f times its words gives k complete epochs, and the rest from a weighted sample without replacement: each document draws the exponential key -ln(u) / quality weight, u being a hash
of its id and text, documents are taken in the order of their keys, and a running sum of their sizes stops at the token budget. The
document at the border gives the words that are still missing.

The running sums need no sort of whole sources: keys fall into buckets of about BUCKET documents by a monotone map, sums
of buckets locate each source's border, and only the border's bucket is put in order. What comes out is one row for each
source with its border, by which each document decides for itself. Texts are shuffled once where whole rows are mixed, to meet
their weights, and otherwise not at all.

Defined cases: null texts have size 0; a null source is a source of its own, last in order; a source without words has
target 0; documents of equal keys go by text and id; rows that repeat id, text and source are documents of their own with equal results, so if they lie at the
border, each gets its part of what is missing, rounded down; very long texts count as a whole; no documents give no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, joined, quoted, scratch, words

MOST = 3
BUCKET = 5000
#: Quality weights by the label in `labels`; documents without one weigh UNKNOWN.
GOOD, POOR, UNKNOWN = 2.0, 0.5, 1.0


def uniform(*cols: Column) -> Column:
    """A number between 0 and 1, from the first 13 hexadecimal digits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def ranked(s: Scratch, df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `rank` from 0 in a total order: ranges of it are numbered on their own and shifted by what stands before them, so no
    task sees all rows."""
    dealt = s.save(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    shift = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("rank", number).join(F.broadcast(shift), "part").withColumn("rank", F.col("rank") + F.col("shift")).drop("part", "shift")


def targets(s: Scratch, sizes: DataFrame, total: int | None = None) -> DataFrame:
    """sizes(source, docs, size) -> with `target` added. Weights 1, 2, 3, repeating by the sources' order, null last. What sources cannot take is
    shared again among the others by weight until all fit; each round is a sum over the sources."""
    w = ranked(s, sizes, [F.col("source").isNull(), F.col("source")])
    w = s.save(w.withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", MOST * F.col("size")))
    every = w.agg(F.sum("size"), F.sum("weight")).first()
    wanted, weights = (every[0] or 0) if total is None else total, every[1] or 0
    level, full = wanted / weights if weights else 0.0, -1
    while True:
        above = w.where(F.lit(level) * F.col("weight") > F.col("cap")).agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if above[0] == full or above[2] == weights:
            break
        full, level = above[0], (wanted - above[1]) / (weights - above[2])
    return w.select("source", "docs", "size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, name: str) -> DataFrame:
    """docs with a struct column `name`: id as text, source, size and content (MD5 of the text)."""
    text, source = F.col(quoted(text_col)), F.col(quoted(source_col))
    fields = [
        F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"), F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("source"),
        F.size(words(text)).cast("long").alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("content"),
    ]
    return docs.withColumn(name, F.struct(*fields))


def keyed(df: DataFrame, quality: DataFrame | None, name: str) -> DataFrame:
    """df, whose struct `name` comes from sized(), with weight and exponential key added to the struct.
    quality(id, weight): one row for each id. It grows with the documents, so both sides are dealt out by id and never broadcast."""
    columns, x = [quoted(c) for c in df.columns if c != name], F.col(name)
    weight = F.lit(1.0)
    if quality is not None:
        at, own = fresh(df, "at", "weight")
        df = df.withColumn(at, x["id"]).join(quality.select(F.col("id").alias(at), F.col("weight").alias(own)).hint("merge"), at, "left")
        weight = F.coalesce(F.col(own), F.lit(UNKNOWN))
    key = -F.ln(uniform(x["id"], x["content"])) / weight
    return df.select(*columns, F.struct(*[x[c].alias(c) for c in ("id", "source", "size", "content")], key.alias("key"), weight.alias("weight")).alias(name))


def borders(s: Scratch, base: DataFrame, total: int | None) -> DataFrame:
    """base(id, source, size, content, key, weight), saved -> a row for each source: source, source_size, target, epochs, and the
    document at its border (key, content, id; null if there is none) with the words that are taken of it, `part`."""
    sizes = s.save(base.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("size")))
    named = sizes.select(F.when(~F.col("source.none"), F.col("source.name")).alias("source"), "docs", "size")
    plan = targets(s, named, total).withColumnRenamed("size", "source_size")
    plan = plan.withColumn("source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = s.save(plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET))).drop("docs"))

    # 1 - exp(-key * least weight) is uniform for the least weight and denser by a bounded factor for others.
    least = base.agg(F.min("weight")).first()[0] or 1.0
    dealt = joined(base, plan.select("source", "budget", "buckets"), ["source"], "inner")
    dealt = dealt.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * least)) * F.col("buckets")).cast("long"))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.any_value("budget").alias("budget"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    border = s.save(sums.withColumn("before", before).where("before + words > budget").groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("border")))
    inside = joined(dealt, border, ["source"], "inner").where("bucket = border.bucket").groupBy("source", "key", "content", "id").agg(F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("budget").alias("budget"), F.any_value("border.before").alias("before"))
    run = F.col("before") + F.coalesce(F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("source").orderBy("key", "content", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = inside.withColumn("run", run).where("run + copies * size > budget").groupBy("source").agg(F.min(F.struct("key", "content", "id", F.floor((F.col("budget") - F.col("run")) / F.col("copies")).cast("long").alias("part"))).alias("at"))
    return s.save(plan.join(at, "source", "left").select("source", "source_size", "target", "epochs", "at"))


def decided(df: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """df, with keyed()'s struct `name`, of which each row decides what is taken of it: source_size, target, epochs and taken come into the struct."""
    k, source = F.col(name), fresh(df, "source")[0]
    plan_ = fresh(df, "plan")[0]
    out = joined(df.withColumn(source, k["source"]), plan.select(F.col("source").alias(source), F.struct("source_size", "target", "epochs", "at").alias(plan_)), [source], "inner")
    p = F.col(plan_)
    at, own = p["at"], F.struct(k["key"].alias("key"), k["content"].alias("content"), k["id"].alias("id"))
    part = F.when(at.isNull(), k["size"]).when((k["id"] == at["id"]) & (k["content"] == at["content"]), at["part"]).when(own < F.struct(at["key"].alias("key"), at["content"].alias("content"), at["id"].alias("id")), k["size"]).otherwise(0)
    fields = [k["size"].alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), (p["epochs"] * k["size"] + part).cast("long").alias("taken"), p["epochs"].alias("epochs"), k["content"].alias("content")]
    return out.withColumn(name, F.struct(*fields)).select(*[F.col(quoted(c)) for c in df.columns])


def weights(s: Scratch, quality: DataFrame | None) -> DataFrame | None:
    """Of quality(doc_id, weight) one row for each id, the largest weight, saved."""
    return None if quality is None else s.save(quality.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("weight").cast("double").alias("weight")))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs, content): one row for each row of docs. taken: the words the
    mix takes of it, repeats counted; epochs: how often it is taken whole; content: MD5 of the text.
    quality(doc_id, weight > 0): weights for sampling, 1 where missing; several for one id: the largest."""
    with scratch(docs.sparkSession) as s:
        (name,) = fresh(docs, "mix")
        narrow = sized(docs, id_col, text_col, source_col, name).select(F.col(quoted(id_col)).alias("doc_id"), F.col(name).alias("mix"))
        base = s.save(keyed(narrow, weights(s, quality), "mix"))
        return s.keep(decided(base, borders(s, base.select("mix.*"), total), "mix").select("doc_id", "mix.*"))


def mixed_rows(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: int | None = None) -> DataFrame:
    """docs, all columns of it, with mix()'s results in a struct column `_mix` (or a name like it), the last. Borders come from a
    first pass over the texts; in the second, rows are decided on where they are read."""
    with scratch(docs.sparkSession) as s:
        (name,) = fresh(docs, "mix")
        rows, known = sized(docs, id_col, text_col, source_col, name), weights(s, quality)
        plan = borders(s, s.save(keyed(rows.select(name), known, name).select(f"{name}.*")), total)
        return s.keep(decided(keyed(rows, known, name), plan, name))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels(doc_id, quality)."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(UNKNOWN).alias("weight"))
