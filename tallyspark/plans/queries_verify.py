"""Queries of the balance rule over the ledgers of all accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..sources.ledger import LEDGER, for_duckdb, ledger
from .catalog import query

L = f"l AS ({for_duckdb(LEDGER)})"
CHAIN = f"""{L}, g AS (SELECT *, lag(balance_cents) OVER (PARTITION BY doc_id ORDER BY idx) AS previous FROM l),
c AS (SELECT *, previous + amount_cents AS expected, previous IS NOT NULL AND balance_cents IS NOT NULL AS checked, previous + amount_cents = balance_cents AS agrees FROM g)"""
#: After sign correction.
FIXED = f"""{CHAIN}, t AS (SELECT *, coalesce(checked AND NOT agrees AND amount_cents <> 0 AND previous - amount_cents = balance_cents, false) AS sign_corrected FROM c),
f AS (SELECT doc_id, idx, okey, txn_date, CASE WHEN sign_corrected THEN -amount_cents ELSE amount_cents END AS amount_cents, balance_cents, previous, sign_corrected, checked FROM t),
s AS (
  SELECT doc_id, count(*) AS n_rows, count(*) FILTER (checked) AS checked, count(*) FILTER (checked AND previous + amount_cents = balance_cents) AS matched, count(*) FILTER (sign_corrected) AS sign_corrections,
    count(*) FILTER (amount_cents = 0) AS zero_rows FROM f GROUP BY doc_id),
r AS (SELECT *, CASE WHEN checked > 0 THEN matched / checked::DOUBLE ELSE 0.0::DOUBLE END AS pass_rate FROM s)"""


def _summary(spark, sf_dir):
    counts = (F.count_if("sign_corrected").alias("sign_corrections"), F.count_if(F.col("amount_cents") == 0).alias("zero_rows"))
    return R.summary(R.correct_signs(ledger(spark, sf_dir)), more=counts)


@query(f"WITH {CHAIN} SELECT doc_id, idx, previous, expected, checked, CASE WHEN checked THEN agrees END AS agrees, balance_cents - previous AS balance_change, expected - balance_cents AS balance_error FROM c")
def w1_balance_chain(spark, sf_dir):
    return R.balance_chain(ledger(spark, sf_dir)).select("doc_id", "idx", "previous", "expected", "checked", "agrees", "balance_change", "balance_error")


@query(f"WITH {FIXED} SELECT doc_id, idx, amount_cents, sign_corrected FROM f")
def w2_sign_correction(spark, sf_dir):
    return R.correct_signs(ledger(spark, sf_dir)).select("doc_id", "idx", "amount_cents", "sign_corrected")


@query(f"WITH {FIXED} SELECT doc_id, n_rows, checked, matched, pass_rate, sign_corrections, checked - matched AS n_mismatches FROM r")
def a8_reconcile_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("doc_id", "n_rows", "checked", "matched", "pass_rate", "sign_corrections", F.size("mismatches").cast("long").alias("n_mismatches"))


@query(f"WITH {CHAIN} SELECT doc_id, idx, expected, balance_cents AS actual, balance_cents - previous AS balance_change FROM c WHERE checked AND NOT agrees")
def a8_mismatches(spark, sf_dir):
    return R.summary(ledger(spark, sf_dir)).select("doc_id", F.explode("mismatches").alias("m")).select("doc_id", "m.idx", "m.expected", "m.actual", "m.balance_change")


@query(f"WITH {CHAIN} SELECT doc_id, idx, CASE WHEN checked AND NOT agrees THEN 'balance-mismatch' ELSE '' END AS flags FROM c")
def j9_mismatch_flags(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("flags", F.array().cast("array<string>"))
    return R.flag_mismatches(R.flag_mismatches(rows)).select("doc_id", "idx", F.array_join("flags", "; ").alias("flags"))


@query("""SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS chars, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS letters, length(regexp_replace(text, '[^�]', '', 'g'))::BIGINT AS broken
FROM documents""")
def a13_text_metrics(spark, sf_dir):
    m = R.text_metrics(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", m["chars"].cast("long").alias("chars"), m["letters"].cast("long").alias("letters"), m["broken"].cast("long").alias("broken"))


@query(f"""WITH {FIXED}, q AS (SELECT *, 60 * n_rows AS chars, CASE WHEN doc_id % 7 = 0 THEN 10 ELSE 30 END * n_rows AS letters, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 0 END * n_rows AS broken, ceil(n_rows / 4.0) AS pages FROM r)
SELECT doc_id, CASE WHEN chars / pages < 40 OR letters / chars::DOUBLE < 0.25::DOUBLE OR broken / chars::DOUBLE > 0.03::DOUBLE THEN 'needs_ocr' WHEN n_rows < 2 THEN 'low_confidence' WHEN checked >= 3 AND pass_rate < 0.8::DOUBLE THEN 'low_confidence'
  WHEN zero_rows > 0.5 * n_rows THEN 'low_confidence' ELSE 'ok' END AS status FROM q""")
def a14_quality_verdict(spark, sf_dir):
    n, doc = F.col("n_rows"), F.col("doc_id")
    status = R.quality(60 * n, F.when(doc % 7 == 0, 10).otherwise(30) * n, F.when(doc % 13 == 0, 2).otherwise(0) * n, F.ceil(n / 4.0), n, F.col("checked"), F.col("pass_rate"), F.col("zero_rows"))
    return _summary(spark, sf_dir).select("doc_id", status.alias("status"))


@query(f"WITH {FIXED} SELECT doc_id, CASE WHEN checked >= 3 AND pass_rate >= 0.98::DOUBLE THEN 'ok' WHEN checked >= 1 THEN 'partial' ELSE 'none' END AS badge FROM r")
def d18_verified_badge(spark, sf_dir):
    return _summary(spark, sf_dir).select("doc_id", R.badge(F.col("checked"), F.col("pass_rate")).alias("badge"))


@query(f"""WITH {FIXED} SELECT doc_id, checked >= 3 AND pass_rate >= 0.98::DOUBLE AS badge, checked >= 3 AND pass_rate >= 0.95::DOUBLE AS baseline, checked > 0 AND pass_rate >= 0.95::DOUBLE AND n_rows >= 3 AS command,
  pass_rate >= 0.95::DOUBLE AND n_rows >= 3 AND checked - matched <= 1 AS gate FROM r""")
def q12_good_enough(spark, sf_dir):
    issues = F.col("checked") - F.col("matched")
    return _summary(spark, sf_dir).select("doc_id", *[f(F.col("n_rows"), F.col("checked"), F.col("pass_rate"), issues).alias(name) for name, f in R.GOOD_ENOUGH.items()])


@query(f"WITH {FIXED} SELECT count(*) AS n_docs, count(*) FILTER (checked >= 3 AND pass_rate >= 0.95::DOUBLE) AS publishable, sum(n_rows)::BIGINT AS n_rows, sum(matched)::BIGINT AS matched FROM r")
def a26_publishable_count(spark, sf_dir):
    return _summary(spark, sf_dir).agg(F.count("*").alias("n_docs"), F.count_if((F.col("checked") >= 3) & (F.col("pass_rate") >= 0.95)).alias("publishable"), F.sum("n_rows").alias("n_rows"), F.sum("matched").alias("matched"))


@query(f"WITH {L} SELECT doc_id, true AS date, true AS description, bool_or(amount_cents < 0) AS debit, bool_or(amount_cents > 0) AS credit, bool_or(balance_cents IS NOT NULL) AS balance, NOT bool_or(amount_cents <> 0) AS amount FROM l GROUP BY doc_id")
def f13_column_presence(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("doc_id", F.col("txn_date").cast("string").alias("iso"), F.lit("x").alias("description"), F.when(F.col("amount_cents") < 0, -F.col("amount_cents")).alias("debit_cents"), F.when(F.col("amount_cents") > 0, F.col("amount_cents")).alias("credit_cents"), "balance_cents")
    return R.present_columns(rows)


@query(f"""WITH {L}, k AS (SELECT doc_id, 100000 AS closing FROM l GROUP BY doc_id)
SELECT l.doc_id, idx, (closing - sum(amount_cents) OVER (PARTITION BY l.doc_id) + sum(amount_cents) OVER (PARTITION BY l.doc_id ORDER BY idx))::BIGINT AS balance_cents FROM l JOIN k USING (doc_id)""")
def w5_running_balance(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("closing_cents", F.lit(100000).cast("long"))
    return R.running_balance(rows).select("doc_id", "idx", "balance_cents")


@query(f"WITH {CHAIN} SELECT CASE WHEN NOT checked THEN 'unchecked' WHEN agrees THEN 'agrees' ELSE 'balance-mismatch' END AS flag, count(*) AS n FROM c GROUP BY ALL")
def a23_flag_histogram(spark, sf_dir):
    flag = F.when(~F.col("checked"), "unchecked").when(F.col("agrees"), "agrees").otherwise("balance-mismatch")
    return R.balance_chain(ledger(spark, sf_dir)).groupBy(flag.alias("flag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag")


@query(f"WITH {FIXED} SELECT CASE WHEN checked >= 3 AND pass_rate >= 0.98::DOUBLE THEN 'ok' WHEN checked >= 1 THEN 'partial' ELSE 'none' END AS status, count(*) AS n, sum(matched)::BIGINT AS constraints FROM r GROUP BY ALL")
def a24_verdict_histogram(spark, sf_dir):
    return _summary(spark, sf_dir).groupBy(R.badge(F.col("checked"), F.col("pass_rate")).alias("status")).agg(F.count("*").alias("n"), F.sum("matched").alias("constraints"))
