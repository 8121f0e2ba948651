"""Evaluation records: baselines, verification reports, artifacts, previews. They hold counts and verdicts, never texts of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: What a record may say of a document; anything else is refused.
ALLOWED = {"doc_id", "outcome", "reason", "pages", "rows", "rate", "checked", "quality", "date_order", "issues", "publishable", "status", "score_gap", "duration_ms"}


def read_truth(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ground truth or manifests, one JSON document for each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def baseline(summary: DataFrame, refused: DataFrame) -> DataFrame:
    """K8: a record for each document of summary (doc_id, pages, n_rows, pass_rate, checked, quality), or of refused(doc_id, reason)."""
    parsed = summary.select("doc_id", F.lit("parsed").alias("outcome"), F.col("pages").cast("long").alias("pages"), F.col("n_rows").cast("long").alias("rows"), (F.floor(F.col("pass_rate") * 10000 + 0.5) / 10000).alias("rate"), F.col("checked").cast("long").alias("checked"), "quality", F.lit(None).cast("string").alias("reason"))
    out = refused.select("doc_id", F.lit("refused").alias("outcome"), "reason")
    return parsed.unionByName(out, allowMissingColumns=True)


def regressions(now: DataFrame, floor: DataFrame) -> DataFrame:
    """Documents whose rows, checks or rate fell below a recorded baseline."""
    b = floor.select("doc_id", *[F.col(c).alias(f"was_{c}") for c in ("outcome", "rows", "checked", "rate")])
    fell = lambda c: F.col(c) < F.col(f"was_{c}")
    return now.join(b, "doc_id").where((F.col("outcome") != F.col("was_outcome")) | fell("rows") | fell("checked") | fell("rate"))


def verify_report(summary: DataFrame) -> DataFrame:
    """K9: what speaks for publishing a layout: rows, rate, and whether at least three rows reconcile at 95 %."""
    ok = (F.col("checked") > 0) & (F.col("pass_rate") >= 0.95) & (F.col("n_rows") >= 3)
    return summary.select("doc_id", "pages", F.col("n_rows").alias("rows"), F.col("pass_rate").alias("rate"), "checked", "quality", ok.alias("publishable"))


def with_totals(report: DataFrame) -> tuple[DataFrame, Observation]:
    """K9: the report, and totals that the job which writes it counts while its rows pass; read them (`.get`) after that job."""
    seen = Observation("totals")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return report.observe(seen, F.count(F.lit(1)).alias("documents"), total("rows"), total("checked"), F.count_if("publishable").alias("publishable"), F.count_if(F.col("quality") != "ok").alias("doubtful")), seen


def write_artifacts(records: DataFrame, path: str) -> None:
    """JSON records, never over earlier ones. Columns outside the allow-list are an error."""
    if unknown := set(records.columns) - ALLOWED:
        raise ValueError(f"records may not hold {sorted(unknown)}")
    records.write.mode("errorifexists").json(path)


def preview(rows: DataFrame, flagged_only: bool = False, limit: int = 300) -> DataFrame:
    """The first rows of each statement; flagged_only: those with a flag other than the multi-line one."""
    if flagged_only:
        rows = rows.where(F.exists("flags", lambda f: f != "multiline-description"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


