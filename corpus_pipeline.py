"""A corpus pipeline of five stages, each of them one of the corpus operators. Each stage's result is written as Parquet
and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, fresh, joined, quoted, scratch
from tallyspark.llm.decontaminate import decontaminate
from tallyspark.llm.langid import identify, train
from tallyspark.llm.linededup import drop_boilerplate
from tallyspark.llm.mixing import label_weights, mixed_rows
from tallyspark.llm.neardup import near_duplicates


def without_texts(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs but for the rows whose text has its MD5 in gone(key). Only digests travel if gone is short."""
    return joined(docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))), gone, [key], "left_anti").select(*[quoted(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects; equal texts have equal verdicts."""
    (key,) = fresh(docs, "text_md5")
    texts = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    with scratch(spark) as s:
        gone = s.keep(identify(texts, train(docs), id_col=key).where("rejected").select(F.col("id").alias(key)).distinct())
    return without_texts(docs, gone, key)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines from the texts; n_chars follows the text."""
    out = drop_boilerplate(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id; of rows that repeat that id in a group,
    the one with the smallest text hash, and of equal texts the one whose row is the first as JSON, whatever the order of rows. Documents without words or without an id stay."""
    (key,) = fresh(docs, "content")
    with scratch(spark) as s:
        found = near_duplicates(docs).where("set_no is not null")
        gone = s.keep(found.where("not kept").select("doc_id", F.col("content").alias(key)).distinct())
        many = s.save(found.where("kept").groupBy("set_no").agg(F.count("*").alias("rows"), F.min("content").alias("one")).where("rows > 1").select("set_no", "one"))
        out = joined(docs.withColumn(key, F.xxhash64("text")), gone, ["doc_id", key], "left_anti")
        if many.limit(1).count():  # rows that repeat an id in a group
            listed = s.keep(joined(found.where("kept"), many, ["set_no"], "inner").select("doc_id", F.col("content").alias(key), (F.col("content") == F.col("one")).alias("stays")).distinct())
            one = joined(out, s.save(listed.where("stays").drop("stays")), ["doc_id", key], "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*[quoted(c) for c in docs.columns]), F.to_json(F.struct(*[quoted(c) for c in docs.columns]))).alias("row"))
            rest = joined(out, s.save(listed.drop("stays")), ["doc_id", key], "left_anti").select(*[quoted(c) for c in docs.columns])
            return s.keep(rest.unionByName(one.select("row.*")))
    return out.select(*[quoted(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in passages of the benchmark."""
    (key,) = fresh(docs, "text_md5")
    texts = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    with scratch(spark) as s:
        found = decontaminate(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
        gone = s.keep(found.where("contaminated").select(F.col("id").alias(key)).distinct())
    return without_texts(docs, gone, key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the mix takes, with columns size, source_size, target, taken (words, repeats counted) and epochs (how often the
    document is taken whole) behind those of the documents; a name that the documents have stays theirs."""
    names = ["size", "source_size", "target", "taken", "epochs"]
    out = mixed_rows(docs, label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    mixed = F.col(out.columns[-1])
    return out.where(mixed["taken"] > 0).select(*[quoted(c) for c in docs.columns], *[mixed[c].alias(c) for c in names if c not in docs.columns])


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]
#: Language identification is learned, so SQL can't express the pipeline; tests hold it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table lies below the session's shared folder until the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        own = Scratch(spark)
        docs = own.save(stage(spark, docs, sf_dir))
        if last is not None:
            last.drop()
        last = own
    return docs
