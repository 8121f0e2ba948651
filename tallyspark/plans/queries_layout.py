"""Queries of the layout engine over statements printed from all ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..session import settle
from ..operators.cluster import clustered, line_pitch
from ..sources.ledger import PRINTED, RUNS, for_duckdb, runs
from ..sources.runs import text_runs
from .catalog import query, table
from .statement import build_statements, date_context

P = f"p AS ({for_duckdb(PRINTED)})"
R = f"r AS ({for_duckdb(RUNS)})"
#: Printed rows with the dates as they are read: in odd documents without a day above 12, day and month are swapped.
READ = f"""{P}, v AS (SELECT doc_id, bool_or(day(txn_date) > 12) AS plain, count(*) AS n, count(balance_cents) AS nb FROM p GROUP BY doc_id),
q AS (SELECT p.*, n, nb, CASE WHEN doc_id % 2 = 1 AND NOT plain THEN strftime(txn_date, '%Y-%d-%m') ELSE strftime(txn_date, '%Y-%m-%d') END AS iso FROM p JOIN v USING (doc_id))"""


@query("""WITH RECURSIVE s AS (SELECT s_nationkey, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS i FROM supplier),
f AS (SELECT s_nationkey, i, v, v AS sum, 1 AS n, 0 AS g FROM s WHERE i = 1
  UNION ALL SELECT s.s_nationkey, s.i, s.v, CASE WHEN abs(s.v - sum / n) <= 400 THEN sum + s.v ELSE s.v END, CASE WHEN abs(s.v - sum / n) <= 400 THEN n + 1 ELSE 1 END, CASE WHEN abs(s.v - sum / n) <= 400 THEN g ELSE g + 1 END FROM f JOIN s ON s.s_nationkey = f.s_nationkey AND s.i = f.i + 1)
SELECT s_nationkey, v, g::INT AS g FROM f""")
def a1_running_mean_clusters(spark, sf_dir):
    """A1 on balances of suppliers, many near their neighbours: means drift, so gaps alone don't tell the clusters."""
    items = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("v"))
    return clustered(items, ["s_nationkey"], "v", 400.0, ["s_suppkey"]).select("s_nationkey", "v", F.col("cluster").alias("g"))


@query("""WITH RECURSIVE s AS (SELECT o_custkey, o_totalprice / 1000 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 1000, o_orderkey) AS i FROM orders),
f AS (SELECT o_custkey, i, v, v AS sum, 1 AS n, 0 AS g FROM s WHERE i = 1
  UNION ALL SELECT s.o_custkey, s.i, s.v, CASE WHEN abs(s.v - sum / n) <= 20 THEN sum + s.v ELSE s.v END, CASE WHEN abs(s.v - sum / n) <= 20 THEN n + 1 ELSE 1 END, CASE WHEN abs(s.v - sum / n) <= 20 THEN g ELSE g + 1 END FROM f JOIN s ON s.o_custkey = f.o_custkey AND s.i = f.i + 1)
SELECT o_custkey, g::INT AS cluster, count(*) AS n, min(v) AS least, max(v) AS most FROM f GROUP BY ALL""")
def a1_clusters_of_amounts(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("v"))
    return clustered(items, ["o_custkey"], "v", 20.0, ["o_orderkey"]).groupBy("o_custkey", "cluster").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("SELECT o_custkey, coalesce(median(o_totalprice), 0) AS median FROM orders GROUP BY o_custkey")
def a6_median(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(F.median("o_totalprice"), F.lit(0.0)).alias("median"))


@query(f"WITH {R} SELECT doc_id, page, ord, str, x, y, w, h FROM r")
def s3_text_runs(spark, sf_dir):
    """S3: positioned runs, white space collapsed and blank ones dropped."""
    return text_runs(runs(spark, sf_dir))


@query(f"""WITH {R} SELECT doc_id, page, y, count(*) AS runs, string_agg(str, ' ' ORDER BY x, ord) AS text FROM r GROUP BY ALL""")
def a2_rows(spark, sf_dir):
    return layout.build_rows(runs(spark, sf_dir)).select("doc_id", "page", "y", F.size("cells").cast("long").alias("runs"), "text")


@query(f"""WITH {READ}, d AS (SELECT DISTINCT doc_id, n, nb FROM q) SELECT doc_id, CASE WHEN n >= 2 THEN 1 ELSE 0 END::INT AS n_date_bands, ((n >= 2)::INT + (nb >= 2)::INT)::INT AS n_money_bands, CASE WHEN n >= 2 THEN CASE WHEN nb >= 2 THEN 'amount,balance' ELSE 'amount' END ELSE CASE WHEN nb >= 2 THEN 'balance' ELSE '' END END AS tasks FROM d""")
def d1_columns(spark, sf_dir):
    m = layout.detect_columns(layout.build_rows(runs(spark, sf_dir)))
    return m.select("doc_id", F.size("date_bands").alias("n_date_bands"), F.size("money_bands").alias("n_money_bands"), F.array_join(F.transform("money_bands", lambda b: b["task"]), ",").alias("tasks"))


@query(f"WITH {READ}, d AS (SELECT doc_id, max(page)::INT AS pages FROM q GROUP BY doc_id) SELECT doc_id, pages, CASE WHEN pages >= 2 THEN 3 * pages ELSE 0 END::BIGINT AS noise FROM d")
def f5_page_furniture(spark, sf_dir):
    return layout.furniture(layout.build_rows(runs(spark, sf_dir))).groupBy("doc_id").agg(F.max("page").alias("pages"), F.count_if("noise").alias("noise"))


@query(f"WITH {READ} SELECT doc_id, page::INT AS page, count(*) + 2 + CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS in_table FROM q GROUP BY ALL")
def f7_table_window(spark, sf_dir):
    """the window takes in title and heading, and the footer where three rows come before it."""
    rows = layout.table_window(layout.furniture(layout.build_rows(runs(spark, sf_dir))))
    return rows.groupBy("doc_id", "page").agg(F.count_if("in_table").alias("in_table"))


@query(f"WITH {READ} SELECT doc_id, CASE WHEN count(*) FILTER (doc_id % 2 = 1 AND day(txn_date) > 12) > 0 THEN 'DMY' ELSE 'MDY' END AS date_order, count(*) FILTER (day(txn_date) > 12) = 0 AS ambiguous, max(year(txn_date)) FILTER (page <= 2)::INT AS year FROM q WHERE txn_date >= DATE '2000-01-01' OR true GROUP BY doc_id HAVING max(year(txn_date)) FILTER (page <= 2) >= 2000 UNION ALL SELECT doc_id, CASE WHEN count(*) FILTER (doc_id % 2 = 1 AND day(txn_date) > 12) > 0 THEN 'DMY' ELSE 'MDY' END, count(*) FILTER (day(txn_date) > 12) = 0, arg_min(year(txn_date), idx)::INT FROM q GROUP BY doc_id HAVING max(year(txn_date)) FILTER (page <= 2) < 2000")
def a9_date_context(spark, sf_dir):
    r = runs(spark, sf_dir)
    return date_context(r, settle(layout.build_rows(r))).select("doc_id", "date_order", "ambiguous", "year")


#: Under the readings that win: without a balance column a statement has amounts only.
SOLVED = f"""{READ}, s AS (SELECT doc_id, idx, iso, CASE WHEN nb < 2 AND balance_text IS NOT NULL THEN concat(description, ' ', balance_text) ELSE description END AS description, amount_cents AS printed, CASE WHEN nb >= 2 THEN balance_cents END AS balance_cents, n, nb FROM q WHERE n >= 2),
g AS (SELECT *, lag(balance_cents) OVER (PARTITION BY doc_id ORDER BY idx) AS previous FROM s),
c AS (SELECT *, coalesce(previous + printed <> balance_cents AND previous - printed = balance_cents AND printed <> 0, false) AS turned FROM g),
f AS (SELECT *, CASE WHEN turned THEN -printed ELSE printed END AS amount_cents, previous IS NOT NULL AND balance_cents IS NOT NULL AS checked FROM c)"""


@query(f"WITH {SOLVED} SELECT doc_id, idx, iso, description, amount_cents, balance_cents FROM f")
def d5_statements(spark, sf_dir):
    return build_statements(runs(spark, sf_dir))["transactions"].select("doc_id", "idx", "iso", "description", "amount_cents", "balance_cents")


@query(f"""WITH {SOLVED}, t AS (SELECT doc_id, count(*) AS n_rows, count(*) FILTER (checked) AS checked, count(*) FILTER (checked AND previous + amount_cents = balance_cents) AS matched, count(*) FILTER (turned) AS sign_corrections FROM f GROUP BY doc_id),
d AS (SELECT DISTINCT doc_id FROM q)
SELECT doc_id, CASE WHEN n_rows IS NULL THEN 'none' ELSE 'by headings' END AS reading, coalesce(n_rows, 0) AS n_rows, coalesce(checked, 0) AS checked, coalesce(matched, 0) AS matched, coalesce(sign_corrections, 0) AS sign_corrections,
  CASE WHEN coalesce(checked, 0) >= 3 AND matched / checked::DOUBLE >= 0.98::DOUBLE THEN 'ok' WHEN coalesce(checked, 0) >= 1 THEN 'partial' ELSE 'none' END AS badge FROM d LEFT JOIN t USING (doc_id)""")
def d4_reading_of_columns(spark, sf_dir):
    return build_statements(runs(spark, sf_dir))["summary"].select("doc_id", "reading", "n_rows", "checked", "matched", "sign_corrections", "badge")


@query(f"""WITH {READ}, k AS (SELECT DISTINCT doc_id, n, nb FROM q WHERE n >= 2 OR nb >= 2) SELECT doc_id, place, reading_id FROM (
  SELECT doc_id, 1 AS place, 'headings' AS reading_id FROM k WHERE n >= 2 AND nb >= 2) a""")
def o5_best_reading(spark, sf_dir):
    """The best reading of statements with two money columns."""
    out = build_statements(runs(spark, sf_dir))
    two = out["model"].where("size(money_bands) = 2 and size(date_bands) > 0").select("doc_id")
    return out["readings"].where("place = 1").join(two, "doc_id", "left_semi").select("doc_id", "place", "reading_id")


@query(f"WITH {R}, y AS (SELECT DISTINCT doc_id, page, round(y, 1) AS y FROM r), g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS gap FROM y), w AS (SELECT *, median(gap) OVER (PARTITION BY doc_id, page) AS m FROM g WHERE gap > 0.5) SELECT doc_id, page, CASE WHEN count(*) FILTER (gap <= 2 * m) >= 3 THEN median(gap) FILTER (gap <= 2 * m) ELSE median(gap) END AS pitch FROM w GROUP BY ALL")
def a7_line_pitch(spark, sf_dir):
    return line_pitch(runs(spark, sf_dir), ["doc_id", "page"])


@query("""WITH b AS (SELECT * FROM (VALUES ('left', 40.0, 90.0, 65.0), ('mid', 80.0, 140.0, 110.0), ('right', 300.0, 360.0, 330.0)) t(id, lo, hi, anchor)), c AS (SELECT l_orderkey, l_linenumber, l_quantity * 8 AS x, row_number() OVER () AS r FROM lineitem),
n AS (SELECT l_orderkey, l_linenumber, x, id, row_number() OVER (PARTITION BY r ORDER BY abs(anchor - x), lo) AS k FROM c LEFT JOIN b ON x BETWEEN lo - 10 AND hi + 10) SELECT l_orderkey, l_linenumber, id FROM n WHERE k = 1""")
def j1_nearest_band(spark, sf_dir):
    band = lambda i, lo, hi, a: F.struct(F.lit(lo).alias("left"), F.lit(hi).alias("right"), F.lit(a).alias("anchor"), F.lit(i).alias("id"))
    bands = F.array(band("left", 40.0, 90.0, 65.0), band("mid", 80.0, 140.0, 110.0), band("right", 300.0, 360.0, 330.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layout.nearest(F.col("l_quantity") * 8.0, bands)["id"].alias("id"))


@query(f"""WITH RECURSIVE {R}, s AS (SELECT doc_id, x + w AS v, row_number() OVER (PARTITION BY doc_id ORDER BY x + w, page, ord) AS i FROM r),
f AS (SELECT doc_id, i, v, [v] AS firsts, [1] AS counts, 1 AS g FROM s WHERE i = 1
  UNION ALL SELECT doc_id, i, v, CASE WHEN g > len(firsts) THEN list_append(firsts, v) ELSE list_transform(firsts, lambda x, k: CASE WHEN k = g THEN x + v ELSE x END) END,
    CASE WHEN g > len(firsts) THEN list_append(counts, 1) ELSE list_transform(counts, lambda x, k: CASE WHEN k = g THEN x + 1 ELSE x END) END, g
  FROM (SELECT s.doc_id, s.i, s.v, firsts, counts, coalesce(list_position(list_transform(firsts, lambda x, k: abs(x / counts[k] - s.v) <= 3.15::DOUBLE), true), len(firsts) + 1) AS g FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1))
SELECT doc_id, (g - 1)::INT AS g, count(*) AS n, min(v) AS least, max(v) AS most FROM f GROUP BY doc_id, g""")
def a5_first_fit_clusters(spark, sf_dir):
    """A5 on the right edges of all runs of a document. The SQL tries every cluster in order, the engine the last one only."""
    edges = runs(spark, sf_dir).select("doc_id", "page", "ord", (F.col("x") + F.col("w")).alias("v"))
    return clustered(edges, ["doc_id"], "v", 3.15, ["page", "ord"]).groupBy("doc_id", F.col("cluster").alias("g")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def _read(spark, sf_dir):
    """Transactions of all statements under every reading of their money columns."""
    from ..operators import roles
    from .statement import date_context as context

    r = runs(spark, sf_dir)
    rows = settle(layout.build_rows(r))
    model = settle(layout.detect_columns(rows))
    orders = context(r, rows).select("doc_id", "date_order", F.col("year").cast("int").alias("year"))
    return settle(roles.read_amounts(layout.assemble(rows, model, orders)))


#: Scores of all readings: with a balance, the share of checks that hold with either sign counts; without one, few rows with a debit and a credit.
SCORES_OF = f"""WITH {READ}, s AS (SELECT doc_id, idx, n, nb, amount_cents AS a, balance_cents AS b, lag(balance_cents) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM q WHERE n >= 2),
t AS (SELECT doc_id, any_value(nb) AS nb, count(*) AS n_rows, count(*) FILTER (before IS NOT NULL AND b IS NOT NULL) AS checked, count(*) FILTER (b - before IN (a, -a)) AS matched, count(*) FILTER (abs(a) > 0 AND abs(b) > 0) AS sides FROM s GROUP BY doc_id),
u AS (SELECT *, CASE WHEN checked > 0 THEN matched / checked::DOUBLE ELSE 0 END AS agreed FROM t),
k AS (
  SELECT doc_id, 0 AS ord, 'by headings' AS label, 0.06::DOUBLE AS prior, nb >= 2 AS balanced, false AS sided FROM u
  UNION ALL SELECT doc_id, 1, 'amount', 0.02::DOUBLE, false, false FROM u WHERE nb < 2
  UNION ALL SELECT doc_id, 2, 'debit, credit', 0.05::DOUBLE, false, true FROM u WHERE nb >= 2 UNION ALL SELECT doc_id, 3, 'amount, balance', 0.04::DOUBLE, true, false FROM u WHERE nb >= 2 UNION ALL SELECT doc_id, 4, 'debit, balance', 0.02::DOUBLE, true, false FROM u WHERE nb >= 2),
c AS (
  SELECT doc_id, ord, label, CASE WHEN balanced THEN agreed ELSE 0 END AS rate,
    round(0.8::DOUBLE * CASE WHEN balanced AND checked >= 2 THEN agreed ELSE 0 END + 0.2::DOUBLE + prior + CASE WHEN NOT balanced AND CASE WHEN sided THEN sides ELSE 0 END / n_rows::DOUBLE < 0.2::DOUBLE THEN 0.03::DOUBLE ELSE 0 END, 12) AS score
  FROM k JOIN u USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place FROM c)"""


@query(f"""WITH {READ}, s AS (SELECT doc_id, idx, amount_cents AS a, balance_cents AS b FROM q WHERE n >= 2 AND nb >= 2)
SELECT doc_id, idx, 'headings' AS reading_id, NULL::BIGINT AS debit_cents, NULL::BIGINT AS credit_cents, b AS balance_cents, a AS amount_cents FROM s UNION ALL SELECT doc_id, idx, 'amount-balance', NULL, NULL, b, a FROM s
UNION ALL SELECT doc_id, idx, 'debit-balance', abs(a), NULL, b, -abs(a) FROM s UNION ALL SELECT doc_id, idx, 'debit-credit', abs(a), abs(b), NULL, coalesce(abs(b), 0) - abs(a) FROM s""")
def a17_amounts_by_reading(spark, sf_dir):
    """Of statements with two money columns, every row's amounts under each reading."""
    read = _read(spark, sf_dir).where("size(reading.roles) = 2")
    return read.select("doc_id", "idx", "reading_id", "debit_cents", "credit_cents", "balance_cents", "amount_cents")


@query(f"""WITH {SOLVED}, t AS (SELECT doc_id, any_value(n) AS n, count(*) FILTER (checked) AS checked, count(*) FILTER (checked AND previous + amount_cents = balance_cents) AS matched FROM f WHERE nb >= 2 GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN checked >= 2 THEN 0.8::DOUBLE * matched / checked ELSE 0 END + 0.2::DOUBLE + 0.06::DOUBLE, 9) AS score, round(CASE WHEN checked > 0 THEN matched / checked::DOUBLE ELSE 0 END, 9) AS pass_rate FROM t""")
def a18_reading_scores(spark, sf_dir):
    """The score of the reading by headings, of statements with two money columns."""
    from ..operators import roles

    ranked, _ = roles.rank(_read(spark, sf_dir).where("size(reading.roles) = 2"))
    return ranked.where("reading_id = 'headings'").select("doc_id", F.round("score", 9).alias("score"), F.round("pass_rate", 9).alias("pass_rate"))


@query(f"WITH {READ} SELECT doc_id, page::INT AS page, count(*) AS opened, max(idx) AS last FROM q WHERE n >= 2 GROUP BY ALL")
def w3_transaction_groups(spark, sf_dir):
    """Each dated row opens a transaction; numbers run on over pages."""
    out = build_statements(runs(spark, sf_dir))["transactions"]
    return out.groupBy("doc_id", "page").agg(F.count("*").alias("opened"), F.max("idx").alias("last"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 8 BETWEEN 34 AND 96 OR l_quantity * 8 BETWEEN 294 AND 366 AS held FROM lineitem")
def f9_in_band(spark, sf_dir):
    band = lambda lo, hi: F.struct(F.lit(lo).alias("left"), F.lit(hi).alias("right"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layout.in_band(F.col("l_quantity") * 8.0, F.array(band(40.0, 90.0), band(300.0, 360.0))).alias("held"))


@query(f"""{SCORES_OF} SELECT doc_id, place::INT AS place, label, round(score, 3) AS score, round(rate, 2) AS pass_rate FROM ranked WHERE place <= 4""")
def o5_alternatives(spark, sf_dir):
    """The four best readings of every statement with their scores and rates."""
    from ..operators import roles

    return roles.alternatives(roles.rank(_read(spark, sf_dir))[0])


@query(f"WITH {R} SELECT doc_id, min(x) AS table_left, max(x + w) AS table_right, count(*) FILTER (str = 'Date') > 0 AS headed FROM r GROUP BY doc_id")
def a16_table_extent(spark, sf_dir):
    """How far the cells of every statement reach, and whether a heading was found."""
    m = layout.detect_columns(layout.build_rows(runs(spark, sf_dir)))
    return m.select("doc_id", "table_left", "table_right", F.col("header_row").isNotNull().alias("headed"))


@query(f"""WITH {P} SELECT doc_id, page, y::DOUBLE AS y, CASE WHEN doc_id % 2 = 0 AND day(txn_date) <= 12 THEN strftime(txn_date, '%Y-%d-%m') ELSE strftime(txn_date, '%Y-%m-%d') END AS iso FROM p""")
def d15_line_dates(spark, sf_dir):
    """The dates on every line, read with the day first: of documents that print the month first, those with a day above 12 are turned."""
    from ..operators import tokens
    from .statement import line_dates

    return line_dates(tokens.tokenise(runs(spark, sf_dir)), "DMY").select("doc_id", F.col("page").cast("long").alias("page"), "y", "iso")
