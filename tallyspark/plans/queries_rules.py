"""Queries of the tax rules over customers and orders as made-up returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tax as T
from ..sources.ledger import grouped
from .catalog import query, table
from .queries_scalars import PRICED, prices

STATUSES = ("single", "hoh", "mfj", "qss", "mfs")
_list = "['" + "', '".join(STATUSES) + "']"
#: Made-up returns: one for each order.
RETURNS = f"""SELECT o_orderkey, {_list}[1 + o_orderkey % 5] AS status, (2024 + o_orderkey % 4)::INT AS year, o_orderkey % 11 <> 0 AS ssn, o_totalprice AS magi, o_totalprice / 10 AS first, o_totalprice / 20 AS second, o_orderkey % 7 <> 0 AS flag,
  CASE WHEN o_orderkey % 3 = 0 THEN 20000.0 END::DOUBLE AS below, lpad((o_orderkey % 9 * 111)::VARCHAR, 3, '0') AS code FROM orders"""


def returns(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.get(F.array(*[F.lit(s) for s in STATUSES]), (k % 5).cast("int")).alias("status"), (2024 + k % 4).cast("int").alias("year"), (k % 11 != 0).alias("ssn"), p.alias("magi"), (p / 10).alias("first"), (p / 20).alias("second"),
        (k % 7 != 0).alias("flag"), F.when(k % 3 == 0, 20000.0).alias("below"), F.lpad((k % 9 * 111).cast("string"), 3, "0").alias("code"),
    )


_cut = "CAST(floor(greatest(0, magi - CASE WHEN status = 'mfj' THEN 300000 ELSE 150000 END) / 1000) * 100 AS DOUBLE)"


def _tax(income: str) -> str:
    def of(bounds) -> str:
        edges = [*bounds[1:], None]
        return " + ".join(f"greatest(0.0::DOUBLE, {f'least({income}, {hi}.0::DOUBLE)' if hi else income} - {lo}) * {rate}::DOUBLE" for lo, hi, rate in zip(bounds, edges, T.RATES, strict=True))

    table = {"mfj": of(T.BOUNDS["mfj"]), "hoh": of(T.BOUNDS["hoh"]), "single": of(T.BOUNDS["single"])}
    return f"(floor((CASE WHEN status IN ('mfj', 'qss') THEN {table['mfj']} WHEN status = 'hoh' THEN {table['hoh']} WHEN status = 'single' THEN {table['single']} END) * 100 + 0.5::DOUBLE) / 100)"


STD = "coalesce(below, CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.STANDARD.items()) + " END)::DOUBLE"
DONE = f"""d AS (SELECT *, least(qualified, cap) AS capped0, {_cut} AS cut FROM q), e AS (SELECT *, greatest(0.0::DOUBLE, capped0 - cut) AS left0, greatest(0.0::DOUBLE, magi - {STD}) AS before FROM d)
SELECT o_orderkey, reason IS NULL AS eligible, reason, qualified, cap::DOUBLE AS cap, CASE WHEN reason IS NULL THEN capped0 ELSE 0 END AS capped, CASE WHEN reason IS NULL THEN least(cut, capped0) ELSE 0 END AS reduction, CASE WHEN reason IS NULL THEN left0 ELSE 0 END AS deduction,
  CASE WHEN reason IS NOT NULL THEN 0 WHEN year = 2026 AND status <> 'mfs' THEN floor({_tax('before')} - {_tax('greatest(0.0::DOUBLE, before - left0)')} + 0.5::DOUBLE) END::DOUBLE AS tax_saved FROM e"""
WHY = "CASE WHEN NOT (year BETWEEN 2025 AND 2028) THEN 'year' WHEN status = 'mfs' THEN 'filing-status' WHEN NOT ssn THEN 'ssn' END"

@query(f"WITH {PRICED} SELECT k, CASE WHEN k % 4 IN (0, 3) THEN c / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS amount FROM r")
def t1_to_amount(spark, sf_dir):
    """Every price as it is typed in, with a sign or a word that makes it none, or as a plain number with blanks."""
    k, us = F.col("k"), F.concat(F.lit("$"), F.expr(grouped("c", ",", ".")))
    typed = F.when(k % 4 == 0, us).when(k % 4 == 1, F.concat(F.lit("-"), us)).when(k % 4 == 2, F.concat(F.lit("about "), us)).otherwise(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")))
    return prices(spark, sf_dir).select("k", T.to_amount(typed).alias("amount"))


@query(f"WITH r AS ({RETURNS}) SELECT o_orderkey, {_cut} AS reduction FROM r")
def t2_phase_out(spark, sf_dir):
    return returns(spark, sf_dir).select("o_orderkey", T.phase_out(F.col("magi"), F.col("status")).cast("double").alias("reduction"))


@query(f"WITH r AS ({RETURNS}) SELECT o_orderkey, status, {_tax('magi')} AS tax FROM r")
def t3_marginal_tax(spark, sf_dir):
    return returns(spark, sf_dir).select("o_orderkey", "status", T.federal_tax(F.col("magi"), F.col("status")).alias("tax"))


@query(f"WITH r AS ({RETURNS}) SELECT o_orderkey, {WHY} AS reason FROM r")
def t4_eligibility(spark, sf_dir):
    return returns(spark, sf_dir).select("o_orderkey", T.ineligible(F.col("year"), F.col("status"), F.col("ssn")).alias("reason"))


@query(f"WITH r AS ({RETURNS}), b AS (SELECT *, greatest(0.0::DOUBLE, magi - {STD}) AS before FROM r) SELECT o_orderkey, CASE WHEN year = 2026 AND status <> 'mfs' THEN floor({_tax('before')} - {_tax('greatest(0.0::DOUBLE, before - first)')} + 0.5::DOUBLE)::BIGINT END AS saved FROM b")
def t5_tax_saved(spark, sf_dir):
    return returns(spark, sf_dir).select("o_orderkey", T.tax_saved(F.col("year"), F.col("status"), F.col("magi"), F.col("below"), F.col("first")).alias("saved"))


@query("SELECT l_orderkey, l_linenumber, floor(l_discount * 100 * 0.5::DOUBLE * l_quantity * 100 + 0.5::DOUBLE) / 100 AS premium FROM lineitem")
def t7_overtime_premium(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.overtime_premium(F.col("l_discount") * 100, F.col("l_quantity")).alias("premium"))


@query(f"WITH r AS ({RETURNS}), q AS (SELECT *, first + CASE WHEN status = 'mfj' THEN second ELSE 0 END AS qualified, CASE WHEN status = 'mfj' THEN 25000.0 ELSE 12500.0 END::DOUBLE AS cap, CASE WHEN NOT flag THEN 'flsa-exempt' ELSE {WHY} END AS reason FROM r), {DONE}")
def t8_overtime_deduction(spark, sf_dir):
    c = F.col
    out = T.overtime_deduction(c("year"), c("status"), c("ssn"), c("magi"), F.array("first", "second"), c("flag"), c("below"))
    return returns(spark, sf_dir).select("o_orderkey", out.alias("d")).select("o_orderkey", "d.*")


@query(f"""WITH r AS ({RETURNS}), w AS (SELECT *, CASE WHEN code = '000' THEN 'occupation-not-listed' WHEN NOT flag THEN 'not-voluntary' END AS refused FROM r),
q AS (SELECT *, CASE WHEN refused IS NOT NULL THEN 0.0::DOUBLE ELSE first + least(second, 5000.0::DOUBLE) END AS qualified, 25000.0::DOUBLE AS cap, coalesce(refused, {WHY}) AS reason FROM w), {DONE}""")
def t9_tips_deduction(spark, sf_dir):
    c = F.col
    out = T.tips_deduction(c("year"), c("status"), c("ssn"), c("magi"), c("code"), c("first"), c("second"), F.lit(5000.0), c("flag"), c("below"))
    return returns(spark, sf_dir).select("o_orderkey", out.alias("d")).select("o_orderkey", "d.*")


@query("SELECT l_orderkey, l_linenumber, floor(30 * 0.5::DOUBLE * CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE (l_quantity % 10) * 52 END * 100 + 0.5::DOUBLE) / 100 AS premium FROM lineitem")
def t11_overtime_hours(spark, sf_dir):
    """Hours as given, else hours a week times weeks."""
    q = F.col("l_quantity")
    hours = F.when(F.col("l_linenumber") % 2 == 0, q)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.overtime_premium(F.lit(30.0), hours, q % 10, F.lit(52.0)).alias("premium"))
