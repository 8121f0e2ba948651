"""Queries of the token graph, the decoder and chain selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, select, tokens
from ..session import settle
from ..sources.ledger import LEDGER, PRINTED, RUNS, for_duckdb, ledger, runs
from .catalog import query, table

L, P, R = f"l AS ({for_duckdb(LEDGER)})", f"p AS ({for_duckdb(PRINTED)})", f"r AS ({for_duckdb(RUNS)})"
TOKENS = f"""{R}, s AS (SELECT *, string_split(str, ' ') AS words FROM r), u AS (SELECT *, unnest(range(len(words))) AS n, unnest(words) AS text FROM s),
t AS (SELECT doc_id, page, ord, n, text, x + 5.0::DOUBLE * (length(array_to_string(words[1:n], ' ')) + CASE WHEN n > 0 THEN 1 ELSE 0 END) AS x, y, (5 * length(text))::DOUBLE AS width, len(words) > 1 AS estimated FROM u)"""


def _measured(spark, sf_dir):
    return tokens.measured(runs(spark, sf_dir))


def _tokens(spark, sf_dir):
    return settle(_measured(spark, sf_dir))


@query(f"WITH {TOKENS} SELECT doc_id, page, ord, n::INT AS n, text, x, y, width, estimated FROM t")
def e16_tokenise(spark, sf_dir):
    return tokens.tokenise(runs(spark, sf_dir)).select("doc_id", "page", "ord", "n", "text", F.round("x", 6).alias("x"), "y", F.round("width", 6).alias("width"), "estimated")


@query(f"WITH {TOKENS} SELECT a.doc_id, a.page, a.ord, a.n::INT AS n, count(*) AS others FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.y - b.y) <= 6.5 AND (a.ord <> b.ord OR a.n <> b.n) GROUP BY ALL")
def j3_same_baseline(spark, sf_dir):
    return tokens.same_baseline(_measured(spark, sf_dir).select("doc_id", "page", "ord", "n", "y", "pitch")).groupBy(*tokens.first()).agg(F.count("*").alias("others"))


@query(f"""WITH {TOKENS} SELECT a.doc_id, a.page, a.ord, a.n::INT AS n, arg_min(b.text, b.x) FILTER (b.x > a.x) AS right_of, arg_max(b.text, b.x) FILTER (b.x < a.x) AS left_of
FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.y - b.y) <= 6.5 AND (a.ord <> b.ord OR a.n <> b.n) GROUP BY ALL""")
def j5_neighbours(spark, sf_dir):
    return tokens.neighbours(tokens.same_baseline(_measured(spark, sf_dir).select("doc_id", "page", "ord", "n", "text", "x", "y", "pitch")))


@query(f"WITH {TOKENS} SELECT a.doc_id, a.page, a.ord, a.n::INT AS n, count(*) AS below FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND b.y > a.y AND b.y - a.y <= 1.4 * 13 AND b.x < a.x + a.width AND b.x + b.width > a.x GROUP BY ALL")
def j4_stacked_below(spark, sf_dir):
    return tokens.stacked_below(_measured(spark, sf_dir).select("doc_id", "page", "ord", "n", "y", "x1", "x2", "pitch")).groupBy(*tokens.first()).agg(F.count("*").alias("below"))


@query("SELECT o_custkey AS doc_id, 1 AS page, o_orderkey AS ord, 0::INT AS n, year(o_orderdate)::INT AS year FROM orders WHERE o_orderkey % 3 <> 0")
def j7_stacked_years(spark, sf_dir):
    k = F.col("o_orderkey")
    at = lambda i, n, text, x, y: F.struct(F.lit(n).alias("n"), text.alias("text"), F.lit(x).alias("x"), (k * 40.0 + y).alias("y"), F.lit(x).alias("x1"), F.lit(x + 25.0).alias("x2"))
    both = F.array(at(0, 0, F.date_format("o_orderdate", "dd.MM."), 42.0, 0.0), at(1, 1, F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy")).otherwise("total"), 42.0, 12.0))
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), k.alias("ord"), F.lit(12.0).alias("pitch"), F.inline(both))
    return tokens.stacked_years(t)


#: Heights moved by up to 12 in steps of 3, so that lines of neighbouring rows run into each other. A height opens a line unless an earlier one within reach has.
@query(f"""WITH RECURSIVE {TOKENS}, m AS (SELECT doc_id, page, ord, n, text, x, y + 3.0::DOUBLE * (abs(ord) * 7 % 5) AS y FROM t),
h AS (SELECT doc_id, page, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY min(ord)) AS i, min(ord) AS ord FROM m GROUP BY doc_id, page, y),
g AS (SELECT doc_id, page, i, [y] AS ys, [ord] AS seeds FROM h WHERE i = 1
  UNION ALL SELECT h.doc_id, h.page, h.i, CASE WHEN near THEN ys ELSE list_append(ys, h.y) END, CASE WHEN near THEN seeds ELSE list_append(seeds, h.ord) END
  FROM g JOIN h ON h.doc_id = g.doc_id AND h.page = g.page AND h.i = g.i + 1, LATERAL (SELECT len(list_filter(ys, lambda o: abs(o - h.y) <= 6.5::DOUBLE)) > 0 AS near)),
e AS (SELECT doc_id, page, unnest(ys) AS seed_y, unnest(seeds) AS seed_ord FROM (SELECT doc_id, page, arg_max(ys, i) AS ys, arg_max(seeds, i) AS seeds FROM g GROUP BY ALL))
SELECT e.doc_id, e.page, seed_ord, arg_min(m.y, (x, ord, n)) AS y, count(*) AS tokens, string_agg(text, ' ' ORDER BY x, ord, n) AS text FROM e JOIN m ON m.doc_id = e.doc_id AND m.page = e.page AND abs(m.y - seed_y) <= 6.5::DOUBLE GROUP BY e.doc_id, e.page, seed_ord""")
def d6_visual_lines(spark, sf_dir):
    moved = _measured(spark, sf_dir).withColumn("y", F.col("y") + 3.0 * (F.abs("ord") * 7 % 5)).withColumn("pitch", F.lit(13.0))
    return tokens.visual_lines(moved).select("doc_id", "page", "seed_ord", "y", F.size("tokens").cast("long").alias("tokens"), F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("text"))


@query(f"WITH {P} SELECT doc_id, count(*) + count(balance_cents) + max(page) AS candidates, count(*) + count(balance_cents) AS with_decimals FROM p GROUP BY doc_id")
def f10_money_candidates(spark, sf_dir):
    m = tokens.money_candidates(_tokens(spark, sf_dir))
    return m.groupBy("doc_id").agg(F.count("*").alias("candidates"), F.count_if("r.has_decimal").alias("with_decimals"))


@query(f"WITH {P} SELECT doc_id, count(*) + max(page) AS lines, count(*) AS dated, count(*) + count(balance_cents) + max(page) AS figures FROM p GROUP BY doc_id")
def d7_lines(spark, sf_dir):
    lines = tokens.build_lines(_tokens(spark, sf_dir)).where("size(money) > 0")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("dated").alias("dated"), F.sum(F.size("money")).alias("figures"))


@query()
def d8_decode(spark, sf_dir):
    """Chains of every statement, by a beam search; SQL can't express it."""
    lines = settle(tokens.build_lines(_tokens(spark, sf_dir)))
    return decode.decode_documents(lines).select("doc_id", "chain_no", "alternative", "opening_cents", "closing_cents", F.size("amounts").alias("n_amounts"), F.size("constraints").alias("n_constraints"))


LINES = f"{L}, n AS (SELECT doc_id, idx AS line_no, okey % 3 = 0 AS dated, okey % 4 <> 1 AS has_money, amount_cents AS cents, okey FROM l)"
DATED = f"""{LINES}, g AS (SELECT *, dated OR (coalesce(NOT lag(has_money, 1) OVER w, false) AND (coalesce(lag(dated, 1) OVER w, false) OR (coalesce(NOT lag(has_money, 2) OVER w, false) AND coalesce(lag(dated, 2) OVER w, false)))) AS entry_dated
FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""


def _lines(spark, sf_dir):
    k = F.col("okey")
    return ledger(spark, sf_dir).select("doc_id", F.col("idx").alias("line_no"), (k % 3 == 0).alias("dated"), (k % 4 != 1).alias("has_money"), F.col("amount_cents").alias("cents"), "okey")


@query(f"WITH {DATED} SELECT doc_id, line_no, entry_dated FROM g")
def w6_date_look_back(spark, sf_dir):
    return select.dated_lines(_lines(spark, sf_dir)).select("doc_id", "line_no", "entry_dated")


#: Made-up chains: of each document's lines, those of an even and an odd key; the odd one of every fifth document failed its check.
def _chains(lines):
    a = lines.groupBy("doc_id", (F.col("okey") % 2).cast("int").alias("chain_no")).agg(F.collect_list(F.struct("line_no", "cents")).alias("amounts"))
    return a.withColumn("constraints", F.array(F.struct(((F.col("doc_id") % 5 != 0) | (F.col("chain_no") == 0)).alias("passed"))))


SCORED = f"""{DATED}, e AS (SELECT doc_id, (okey % 2)::INT AS chain_no, count(*) AS entries, count(*) FILTER (entry_dated) AS dated_entries, sum(abs(cents)) AS value, coalesce(sum(abs(cents)) FILTER (entry_dated), 0) AS dated_value FROM g GROUP BY ALL HAVING doc_id % 5 <> 0 OR okey % 2 = 0),
z AS (SELECT doc_id, chain_no, entries, dated_entries, round((dated_entries / entries::DOUBLE + 0.6::DOUBLE * dated_value / value::DOUBLE + 0.15::DOUBLE * least(1.0::DOUBLE, entries / 10.0::DOUBLE)) / 1.75::DOUBLE, 6) AS detail_score FROM e)"""
SCORED = SCORED.replace("GROUP BY ALL HAVING doc_id % 5 <> 0 OR okey % 2 = 0", "WHERE doc_id % 5 <> 0 OR okey % 2 = 0 GROUP BY doc_id, (okey % 2)::INT")


@query(f"WITH {SCORED} SELECT * FROM z")
def a19_chain_evidence(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return select.evidence(_chains(lines), lines).select("doc_id", "chain_no", "entries", "dated_entries", F.round("detail_score", 6).alias("detail_score"))


@query(f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER w AS place, lead(detail_score) OVER w AS next FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY detail_score DESC, chain_no)), d AS (SELECT DISTINCT doc_id FROM l),
s AS (SELECT d.doc_id, CASE WHEN chain_no IS NULL THEN 'NO_RECONCILED_CHAIN' WHEN detail_score < 0.35 THEN 'INSUFFICIENT_DETAIL_EVIDENCE' WHEN detail_score - next < 0.15 THEN 'AMBIGUOUS_RECONCILED_CHAINS' ELSE 'CLEAR_DETAIL_CHAIN' END AS reason, chain_no FROM d LEFT JOIN k ON k.doc_id = d.doc_id AND place = 1)
SELECT doc_id, reason, CASE WHEN reason = 'CLEAR_DETAIL_CHAIN' THEN 'selected' ELSE 'partial' END AS status, CASE WHEN reason = 'CLEAR_DETAIL_CHAIN' THEN chain_no END AS chain_no FROM s""")
def d13_select_chain(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    # Scores compete to six places, as they are shown (a19_chain_evidence).
    scored = select.evidence(_chains(lines), lines).withColumn("detail_score", F.round("detail_score", 6))
    return select.select_chains(scored, lines).select("doc_id", "reason", "status", "chain_no")


@query(f"WITH {L} SELECT doc_id, idx, okey FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx // 8 ORDER BY abs(amount_cents) DESC, idx) AS k FROM l) WHERE k <= 5")
def w7_top_five(spark, sf_dir):
    """The five largest figures of a line."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id", F.floor(F.col("idx") / 8)).orderBy(F.desc(F.abs("amount_cents")), "idx"))
    return ledger(spark, sf_dir).withColumn("k", place).where("k <= 5").select("doc_id", "idx", "okey")


@query()
def d14_decoded_statements(spark, sf_dir):
    """The decision on each statement: which chain is selected, or why none is, all chains that competed with their evidence, and what the selected one holds."""
    from .statement import decode_statements

    return decode_statements(runs(spark, sf_dir))["statements"]
