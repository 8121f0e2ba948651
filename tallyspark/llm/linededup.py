"""Lines that a site repeats on many of its pages, dropped by their site-relative frequency.

For each host, the share of its pages that hold a line (trimmed; once a page) is that line's ratio. Lines with a ratio
over max_ratio on at least min_pages pages are boilerplate and go; blank lines stay. A host's boilerplate is a short
list by construction: no more than the lines of an average page divided by max_ratio, so it travels as one array.

Defined cases: a null text is kept as it is (no lines); a null host is a host of its own; a host with under min_pages
pages has no boilerplate; repeated rows are pages of their own; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, joined, quoted, scratch

MAX_RATIO, MIN_PAGES = 0.05, 3


def _trim(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(none, host, lines): for each host, the MD5s of its boilerplate lines. none: the host is null."""
    host = F.struct(F.col("host").isNull().alias("none"), F.coalesce("host", F.lit("")).alias("name"))
    pages = docs.select(F.col(quoted(host_col)).cast("string").alias("host"), F.col(quoted(text_col)).alias("text")).select(host.alias("host"), "text")
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _trim), lambda x: x != ""))
    held = pages.select("host", F.explode(F.transform(lines, lambda x: F.unhex(F.md5(x)))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return held.join(totals, "host").where(F.col("pages") > max_ratio * F.col("total")).groupBy("host").agg(F.collect_list("line").alias("lines")).select("host.none", "host.name", "lines")


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with its text cleaned and a last column `_counts` (n_lines, n_dropped)."""
    none, name, lists, counts, parts, left = fresh(docs, "none", "name", "lists", "counts", "parts", "left")
    with scratch(docs.sparkSession) as s:
        found = s.keep(boilerplate(docs, text_col, host_col, max_ratio, min_pages).select(F.col("none").alias(none), F.col("name").alias(name), F.col("lines").alias(lists)))
    text = F.col(quoted(text_col))
    host = F.col(quoted(host_col)).cast("string")
    out = joined(docs.withColumn(none, host.isNull()).withColumn(name, F.coalesce(host, F.lit(""))), found, [none, name], "left")
    out = out.withColumn(parts, F.split(text, "\n"))
    out = out.withColumn(left, F.when(F.col(lists).isNull(), F.col(parts)).otherwise(F.filter(parts, lambda x: ~F.array_contains(F.col(lists), F.unhex(F.md5(_trim(x)))))))
    out = out.withColumn(counts, F.struct(F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), (F.coalesce(F.size(parts), F.lit(0)) - F.coalesce(F.size(left), F.lit(0))).cast("long").alias("n_dropped")))
    return out.select(*[F.array_join(left, "\n").alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns], counts)
