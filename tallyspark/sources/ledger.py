"""Ledgers and printed statements made from orders and customers: one account's orders are its transactions.

The texts are SQL that Spark and DuckDB read alike; {orders} and {customer} stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fine_partitions, settle

#: Every account's rows in order, amounts and balances in cents, with faults: a printed balance that is off (okey % 97), not
#: printed (okey % 11), an amount of the wrong sign (okey % 53).
LEDGER = """
SELECT doc_id, idx, okey, txn_date, true_cents,
  CASE WHEN okey % 53 = 0 THEN -true_cents ELSE true_cents END AS amount_cents,
  CASE WHEN okey % 11 = 0 THEN NULL WHEN okey % 97 = 0 THEN running + 10000 ELSE running END AS balance_cents
FROM (
  SELECT *, CAST(opening + sum(true_cents) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
  FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o_orderdate, okey) AS BIGINT) AS idx
    FROM (
      SELECT o_custkey AS doc_id, o_orderkey AS okey, o_orderdate, CAST(o_orderdate AS DATE) AS txn_date,
        CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS true_cents,
        CAST(floor(coalesce(c_acctbal, 0) * 100 + 0.5) AS BIGINT) AS opening
      FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey) a) b) d"""


def _int(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def grouped(cents: str, thousands: str, point: str) -> str:
    """SQL for the size of an amount below ten milliards, grouped in threes."""
    a = f"abs({cents})"
    w = _int(f"{a} / 100")
    tail = f"'{point}', lpad(CAST({a} % 100 AS VARCHAR(2)), 2, '0')"
    three = lambda x: f"lpad(CAST({x} % 1000 AS VARCHAR(3)), 3, '0')"
    return (
        f"CASE WHEN {w} >= 1000000 THEN concat(CAST({_int(f'{w} / 1000000')} AS VARCHAR(9)), '{thousands}', {three(_int(f'{w} / 1000'))}, '{thousands}', {three(w)}, {tail})"
        f" WHEN {w} >= 1000 THEN concat(CAST({_int(f'{w} / 1000')} AS VARCHAR(9)), '{thousands}', {three(w)}, {tail}) ELSE concat(CAST({w} AS VARCHAR(9)), {tail}) END"
    )


def indian(cents: str) -> str:
    """SQL for the size of an amount below a hundred crore, grouped 12,34,567.89."""
    a = f"abs({cents})"
    w = _int(f"{a} / 100")
    tail = f"'.', lpad(CAST({a} % 100 AS VARCHAR(2)), 2, '0')"
    three, two = f"lpad(CAST({w} % 1000 AS VARCHAR(3)), 3, '0')", lambda x: f"lpad(CAST({x} % 100 AS VARCHAR(2)), 2, '0')"
    return (
        f"CASE WHEN {w} >= 10000000 THEN concat(CAST({_int(f'{w} / 10000000')} AS VARCHAR(9)), ',', {two(_int(f'{w} / 100000'))}, ',', {two(_int(f'{w} / 1000'))}, ',', {three}, {tail})"
        f" WHEN {w} >= 100000 THEN concat(CAST({_int(f'{w} / 100000')} AS VARCHAR(9)), ',', {two(_int(f'{w} / 1000'))}, ',', {three}, {tail})"
        f" WHEN {w} >= 1000 THEN concat(CAST({_int(f'{w} / 1000')} AS VARCHAR(9)), ',', {three}, {tail}) ELSE concat(CAST({w} AS VARCHAR(9)), {tail}) END"
    )


def printed(cents: str, style: str) -> str:
    """SQL for an amount in one of five styles: US, EU, Indian, parentheses, CR/DR."""
    minus = f"CASE WHEN {cents} < 0 THEN '-' ELSE '' END"
    us, eu = grouped(cents, ",", "."), grouped(cents, ".", ",")
    return (
        f"CASE {style} WHEN 0 THEN concat({minus}, {us}) WHEN 1 THEN concat({minus}, {eu}) WHEN 2 THEN concat({minus}, {indian(cents)})"
        f" WHEN 3 THEN CASE WHEN {cents} < 0 THEN concat('(', {us}, ')') ELSE {us} END ELSE concat({us}, CASE WHEN {cents} < 0 THEN ' DR' ELSE ' CR' END) END"
    )


#: Rows of the ledger as printed: the day first where doc_id is odd.
PRINTED = f"""
SELECT doc_id, idx, okey, txn_date, amount_cents, balance_cents,
  CASE WHEN doc_id % 2 = 0 THEN concat(substr(CAST(txn_date AS VARCHAR(10)), 6, 2), '/', substr(CAST(txn_date AS VARCHAR(10)), 9, 2), '/', substr(CAST(txn_date AS VARCHAR(10)), 1, 4))
    ELSE concat(substr(CAST(txn_date AS VARCHAR(10)), 9, 2), '/', substr(CAST(txn_date AS VARCHAR(10)), 6, 2), '/', substr(CAST(txn_date AS VARCHAR(10)), 1, 4)) END AS date_text,
  concat('Payment to P', CAST(okey AS VARCHAR(20))) AS description,
  {printed("amount_cents", "okey % 5")} AS amount_text,
  CASE WHEN balance_cents IS NOT NULL THEN {printed("balance_cents", "okey % 3")} END AS balance_text,
  {_int("(idx - 1) / 4")} + 1 AS page, 130 + 13 * ((idx - 1) % 4) AS y
FROM ({LEDGER}) l"""

#: Positioned runs: a title, a heading row, four rows a page and a footer.
RUNS = f"""
WITH p AS ({PRINTED}),
pages AS (SELECT DISTINCT doc_id, page FROM p),
cells AS (
  SELECT doc_id, page, idx * 10 + 1 AS ord, date_text AS str, 42.0 AS x, y FROM p
  UNION ALL SELECT doc_id, page, idx * 10 + 2, description, 112.0, y FROM p
  UNION ALL SELECT doc_id, page, idx * 10 + 3, amount_text, 430.0 - 5 * length(amount_text), y FROM p
  UNION ALL SELECT doc_id, page, idx * 10 + 4, balance_text, 528.0 - 5 * length(balance_text), y FROM p WHERE balance_text IS NOT NULL
  UNION ALL SELECT doc_id, page, -9, 'Account statement', 42.0, 104 FROM pages
  UNION ALL SELECT doc_id, page, -8, 'Date', 42.0, 117 FROM pages
  UNION ALL SELECT doc_id, page, -7, 'Description', 112.0, 117 FROM pages
  UNION ALL SELECT doc_id, page, -6, 'Amount', 400.0, 117 FROM pages
  UNION ALL SELECT doc_id, page, -5, 'Balance', 493.0, 117 FROM pages
  UNION ALL SELECT doc_id, page, 1000000, concat('Page ', CAST(page AS VARCHAR(9))), 280.0, 182 FROM pages)
SELECT doc_id, CAST(page AS INT) AS page, CAST(ord AS BIGINT) AS ord, str, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(5 * length(str) AS DOUBLE) AS w, CAST(9 AS DOUBLE) AS h FROM cells"""


def _over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    fine_partitions(spark)
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "customer") if f"{{{name}}}" in sql}
    return spark.sql(sql, **tables)


def for_duckdb(sql: str) -> str:
    return sql.replace("{orders}", "orders").replace("{customer}", "customer")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_tables(spark, sf_dir, LEDGER)


def printed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_tables(spark, sf_dir, PRINTED)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUNS, from one pass over the printed rows: the first row of a page brings what stands on it besides."""
    p = printed_rows(spark, sf_dir).withColumn("page", F.col("page").cast("int")).withColumn("y", F.col("y").cast("double"))
    at = lambda k, text, x: F.struct((F.col("idx") * 10 + k).alias("ord"), text.alias("str"), x.cast("double").alias("x"), F.col("y").alias("y"))
    right = lambda c, edge: F.lit(edge) - 5 * F.length(c)
    cells = F.array(at(1, F.col("date_text"), F.lit(42)), at(2, F.col("description"), F.lit(112)), at(3, F.col("amount_text"), right("amount_text", 430)), at(4, F.col("balance_text"), right("balance_text", 528)))
    fixed = lambda k, text, x, y: F.struct(F.lit(k).cast("long").alias("ord"), text.alias("str"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    frame = F.array(fixed(-9, F.lit("Account statement"), 42, 104), fixed(-8, F.lit("Date"), 42, 117), fixed(-7, F.lit("Description"), 112, 117), fixed(-6, F.lit("Amount"), 400, 117), fixed(-5, F.lit("Balance"), 493, 117), fixed(1000000, F.concat(F.lit("Page "), F.col("page").cast("string")), 280, 182))
    every = F.when(F.col("idx") % 4 == 1, F.concat(cells, frame)).otherwise(cells)
    body = p.select("doc_id", "page", F.inline(F.filter(every, lambda c: c["str"].isNotNull())))
    return settle(body.withColumn("w", (5 * F.length("str")).cast("double")).withColumn("h", F.lit(9.0)))
