"""Text runs, and what is refused before they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze

MAX_PAGES, MAX_BYTES, MIN_CHARS = 200, 60 << 20, 20


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files, hidden ones left out, in order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(~F.substring_index("path", "/", -1).startswith("._")).orderBy("path")


def size_gate(files: DataFrame) -> DataFrame:
    """Files with `error` for those that are too large to read."""
    return files.withColumn("error", F.when(F.col("length") > MAX_BYTES, "FILE_TOO_LARGE"))


def text_runs(items: DataFrame) -> DataFrame:
    """S3: runs with white space collapsed, blank ones dropped, sizes positive; a run without height has height 1."""
    h = F.abs(F.col("h"))
    return items.withColumn("str", squeeze(F.col("str"))).where("str <> ''").withColumn("w", F.abs("w")).withColumn("h", F.when(F.coalesce(h, F.lit(0.0)) == 0, 1.0).otherwise(h))


def from_page_bottom(items: DataFrame, page_height: str = "page_height") -> DataFrame:
    """S3: items placed from the page's lower edge, as readers give them, placed from the upper one."""
    return items.withColumn("y", F.col(page_height) - F.col("y"))


def guards(runs: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(doc_id, pages, chars, error): TOO_MANY_PAGES, or NO_TEXT_LAYER for under 20 characters."""
    g = runs.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.sum(F.length(F.trim("str"))).alias("chars"))
    return g.withColumn("error", F.when(F.col("pages") > max_pages, "TOO_MANY_PAGES").when(F.col("chars") < MIN_CHARS, "NO_TEXT_LAYER"))


def friendly_error(name: Column, code: Column) -> Column:
    """What a reader's failure means."""
    return (
        F.when((name == "PasswordException") | code.isin(1, 2), F.when(code == 2, "WRONG_PASSWORD").otherwise("PASSWORD_NEEDED")).when(name == "InvalidPDFException", "INVALID_FILE")
        .when(name.isin("MissingPDFException", "UnexpectedResponseException", "ResponseException"), "UNREADABLE").otherwise(name)
    )


def page_texts(runs: DataFrame) -> DataFrame:
    """(doc_id, page, text, chars, text_layer): a page's runs in their order; a text layer has over 100 characters."""
    t = runs.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "str"))), lambda r: r["str"]), " ").alias("text"))
    return t.withColumn("chars", F.length("text")).withColumn("text_layer", F.col("chars") > 100)
