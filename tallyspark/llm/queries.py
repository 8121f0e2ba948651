"""The corpus operators as queries over the tables of a folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score", "rejected")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import label_weights, mix

    return mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .warc import ID, read_archives, write_archives

    with scratch(spark) as s:
        paths = write_archives(table(spark, sf_dir, "pages"), s.folder("archives"))
        chunks = read_archives(spark, paths)
        number = lambda c: F.substring(c, len(ID) + 1, 20).try_cast("long")
        records = chunks.groupBy("archive", "offset", "record_id", "record_type", "refers_to").agg(
            F.sum(F.octet_length("payload")).cast("long").alias("read"), F.max("bytes_so_far").alias("told"), F.max_by("digest_so_far", "chunk_no").alias("digest"),
        )
        return s.keep(records.select(
            number(F.col("record_id")).alias("page_id"), F.when(F.col("record_type") == "revisit", F.col("told")).otherwise(F.col("read")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"),
        ))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_boilerplate

    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "_counts.n_lines", "_counts.n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", conflict), (-7, 1, "assistant", conflict)], "conv_id long, turn long, role string, text string")
    return format_chats(turns.unionByName(extra), texts=False).select(F.col("id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_substrings

    return repeated_substrings(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal import find_personal

    return find_personal(table(spark, sf_dir, "documents")).drop("added").withColumnRenamed("id", "doc_id")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def planted(docs: DataFrame) -> DataFrame:
    """docs, where each tenth text by the checksum of its id repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(words):
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i))), " ")

    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), let(words(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    return periodic_runs(planted(table(spark, sf_dir, "documents")), texts=False).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
