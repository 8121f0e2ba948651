"""Queries of the search as rows. Their SQL builds the figures of every statement from the ledger and searches them by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, select, tokens
from ..operators.decode import Weights
from ..session import settle
from ..sources.ledger import PRINTED, for_duckdb, ledger, runs
from .catalog import query

#: So few states that most statements lose some, for the trace; and figures of a statement that is read without losing any.
BEAM, SHORT = 16, 8

#: What tokens make of printed rows: amounts (CR and DR are words of their own), balances and page numbers, with the points of a reading and the column of right edges.
FIGURES = f"""p AS ({for_duckdb(PRINTED)}),
m AS (
  SELECT doc_id, page, y, 0 AS place, CASE WHEN okey % 5 = 4 THEN abs(amount_cents) ELSE amount_cents END AS value, okey % 5 <> 4 AND amount_cents < 0 AS has_sign, CASE WHEN okey % 5 = 4 THEN 'side' ELSE 'amount' END AS col, 55 AS points FROM p WHERE amount_cents <> 0
  UNION ALL SELECT doc_id, page, y, 1, balance_cents, balance_cents < 0, 'balance', 55 FROM p WHERE balance_cents <> 0
  UNION ALL SELECT DISTINCT doc_id, page, 182, 0, page * 100, false, concat('page', length(page::VARCHAR)), 0 FROM p),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, col) AS members FROM m),
f AS (SELECT doc_id, page, y, place, value, abs(value) AS size, has_sign, least(1.0::DOUBLE, (points + CASE WHEN has_sign THEN 20 ELSE 0 END) / 100.0::DOUBLE + 0.45::DOUBLE * least(1.0::DOUBLE, members / 6.0::DOUBLE)) AS confidence, least(1.0::DOUBLE, (members - 1) / 3.0::DOUBLE) AS support FROM n),
e AS (SELECT *, confidence >= 0.55::DOUBLE AS eligible, 1.5::DOUBLE * confidence * (1 + 5.0::DOUBLE * (1 - support)) AS cost FROM f),
l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y) AS step, list({{'value': value, 'size': size, 'has_sign': has_sign, 'confidence': confidence, 'support': support, 'eligible': eligible, 'cost': cost}} ORDER BY place) AS figures
  FROM e GROUP BY doc_id, page, y),
t AS (SELECT *, step = max(step) OVER (PARTITION BY doc_id) AS last, sum(len(figures)) OVER (PARTITION BY doc_id) AS n_figures FROM l)"""


def _given(source: str, figure: str) -> str:
    """SQL: the states of source after the figure got each of its roles. A null figure changes nothing."""
    m = figure
    eligible = f"coalesce({m}.eligible, false)"
    return f"""(SELECT doc_id, step, last, pruned, figures,
      CASE WHEN r >= 3 THEN {m}.value ELSE anchor END AS anchor, CASE WHEN r >= 3 THEN 0 WHEN r = 1 THEN total + CASE WHEN {m}.has_sign AND {m}.value < 0 THEN -{m}.size ELSE {m}.size END WHEN r = 2 THEN total - {m}.size ELSE total END AS total,
      CASE WHEN r >= 3 THEN 0 WHEN r > 0 THEN span + 1 ELSE span END AS span, CASE WHEN r >= 3 THEN 0.0::DOUBLE WHEN r > 0 THEN support + {m}.support ELSE support END AS support,
      CASE WHEN {m} IS NULL THEN score WHEN r = 0 THEN score - {m}.confidence * {m}.confidence * 8.0::DOUBLE WHEN r <= 2 THEN score - {m}.cost WHEN r = 3 THEN score - 4.0::DOUBLE
        ELSE score + (100.0::DOUBLE + 0.8::DOUBLE * span) * greatest(0.15::DOUBLE, least({m}.support, CASE WHEN span > 0 THEN support / span ELSE 0.0::DOUBLE END)) END AS score,
      CASE WHEN {eligible} THEN path * 5 + r ELSE path END AS path, CASE WHEN {m} IS NULL THEN roles ELSE concat(roles, substr('u+-ca', r + 1, 1)) END AS roles
    FROM {source}, (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS r) WHERE r = 0 OR {eligible} AND (r IN (1, 3) OR r = 2 AND NOT {m}.has_sign OR r = 4 AND abs(anchor + total - {m}.value) <= 1))"""


def _searched(beam: int, most: int | None = None) -> str:
    """SQL: FIGURES and `s`, the states of every step before the cut, with rank and number. most: only of statements with at most so many figures."""
    lines = "t" if most is None else f"(SELECT * FROM t WHERE n_figures <= {most})"
    first = "(SELECT s.doc_id, t.step, t.last, s.pruned OR s.states > " + str(beam) + f" AS pruned, t.figures, anchor, total, span, support, score, rank - 1 AS path, roles FROM s JOIN {lines} t ON t.doc_id = s.doc_id AND t.step = s.step + 1 WHERE rank <= {beam})"
    return f"""WITH RECURSIVE {FIGURES},
s AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS step, false AS last, false AS pruned, NULL::BIGINT AS anchor, 0::BIGINT AS total, 0::BIGINT AS span, 0.0::DOUBLE AS support, 0.0::DOUBLE AS score, '' AS roles, 1::BIGINT AS rank, 1::BIGINT AS states FROM {lines}
  UNION ALL
  SELECT doc_id, step, last, pruned, anchor, total, span, support, score, roles, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first), count(*) OVER (PARTITION BY doc_id)
  FROM (
    SELECT *, min(path) OVER (PARTITION BY doc_id, anchor, total) AS first FROM {_given(_given(first, 'figures[1]'), 'figures[2]')}
    QUALIFY row_number() OVER (PARTITION BY doc_id, anchor, total ORDER BY score DESC, path) = 1))"""


def _lines(spark, sf_dir, most: int | None = None):
    r = runs(spark, sf_dir)
    if most is not None:
        r = settle(tokens.short_documents(r, most))
    return settle(tokens.build_lines(settle(tokens.measured(r))))


def _figures(spark, sf_dir):
    return settle(search.figures_of(_lines(spark, sf_dir)))


@query(f"""{_searched(BEAM)} SELECT doc_id, step, max(states) AS states, round(max(score) FILTER (states > {BEAM} AND rank = {BEAM}), 6) AS cutoff FROM s WHERE step > 0 GROUP BY doc_id, step""")
def d16_search_trace(spark, sf_dir):
    """For each step of every statement's search, the states found and the score of the last one kept where some are dropped."""
    out = search.search_together(_figures(spark, sf_dir), Weights(max_states=BEAM))["trace"]
    return out.select("doc_id", F.col("step").cast("long").alias("step"), "states", F.round("cutoff", 6).alias("cutoff"))


#: The states in which a statement has been read as it was meant: a row's balance stands and nothing has come after it.
WATCHED = "w AS (SELECT doc_id, page, y, balance_cents FROM p WHERE balance_cents <> 0), k AS (SELECT DISTINCT doc_id, page, y FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y) AS step FROM k)"


@query(f"""{_searched(BEAM)}, {WATCHED} SELECT o.doc_id, o.step, w.balance_cents AS anchor, s.rank FROM o JOIN w USING (doc_id, page, y) LEFT JOIN s ON s.doc_id = o.doc_id AND s.step = o.step AND s.anchor = w.balance_cents AND s.total = 0""")
def o11_watched_ranks(spark, sf_dir):
    """Before each cut, the rank of the state in which the balance printed on the line stands; null where it was not found."""
    figures = _figures(spark, sf_dir)
    number = figures.select("doc_id", "step", F.row_number().over(search.Window.partitionBy("doc_id").orderBy("step")).alias("place"))
    idx = F.col("idx")
    # A page has four rows and a line with its number.
    rows = ledger(spark, sf_dir).where("balance_cents <> 0").select("doc_id", (idx + F.floor((idx - 1) / 4)).cast("int").alias("place"), F.col("balance_cents").alias("anchor"))
    watched = rows.join(number, ["doc_id", "place"]).select("doc_id", "step", "anchor", F.lit(0).cast("long").alias("total"))
    out = search.search_together(figures, Weights(max_states=BEAM), settle(watched))["ranks"]
    return out.select("doc_id", F.col("step").cast("long").alias("step"), "anchor", "rank")


#: The chains of the best readings among the states `s`.
CHAINS = """b AS (SELECT doc_id, score, roles FROM s WHERE last AND rank = 1),
v AS (SELECT doc_id, flatten(list(list_transform(figures, lambda m: m.value) ORDER BY step)) AS vals FROM t GROUP BY doc_id),
z AS (SELECT doc_id, score, unnest(range(1, length(roles) + 1)) AS place, unnest(string_split(roles, '')) AS role, unnest(vals) AS value FROM b JOIN v USING (doc_id)),
g AS (SELECT *, count(*) FILTER (role = 'c') OVER (PARTITION BY doc_id ORDER BY place) AS opened FROM z),
h AS (SELECT *, max(place) FILTER (role = 'a') OVER (PARTITION BY doc_id, opened) AS closed FROM g),
c AS (SELECT doc_id, score, opened, arg_min(value, place) AS opening_cents, arg_max(value, place) FILTER (role = 'a') AS closing_cents, count(*) FILTER (role IN ('+', '-')) AS n_amounts, count(*) FILTER (role = 'a') AS n_constraints FROM h WHERE opened > 0 AND place <= closed GROUP BY ALL),
x AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY opened) - 1)::INT AS chain_no, opening_cents, closing_cents, n_amounts, n_constraints, score FROM c)"""


def _chains(lines, w: Weights, most: int | None = None):
    figures = settle(search.figures_of(lines))
    if most is not None:
        few = figures.groupBy("doc_id").agg(F.sum(F.size("figures")).alias("n")).where(F.col("n") <= most).select("doc_id")
        figures = settle(figures.join(few, "doc_id", "left_semi"))
    # A short document has some thousand states, and is searched without a cut.
    found = search.search_together(figures, w) if most is None else search.search(figures, w, least=200)
    return search.chains(found["best"], figures)


def _shown(chains):
    return chains.select("doc_id", "chain_no", "opening_cents", "closing_cents", F.size("amounts").cast("long").alias("n_amounts"), F.size("constraints").cast("long").alias("n_constraints"), F.round("score", 6).alias("score"))


SHOWN = "SELECT doc_id, chain_no, opening_cents, closing_cents, n_amounts, n_constraints, round(score, 6) AS score FROM x"


@query(f"{_searched(1 << 40, SHORT)}, {CHAINS} {SHOWN}")
def d8_exact(spark, sf_dir):
    """The chains of the best reading of every statement of at most SHORT figures, found without dropping a state. Longer ones are the decoder's (d8_decode)."""
    return _shown(_chains(_lines(spark, sf_dir, SHORT), Weights(max_states=1 << 40), SHORT))


@query(f"{_searched(BEAM)}, {CHAINS} {SHOWN}")
def d8_chains(spark, sf_dir):
    """The chains of the best reading of every statement that a beam of BEAM states finds."""
    return _shown(_chains(_lines(spark, sf_dir), Weights(max_states=BEAM)))


@query(f"""{_searched(BEAM)}, {CHAINS},
r AS (SELECT doc_id, chain_no, round(CASE WHEN n_amounts > 0 THEN (1.0::DOUBLE + 0.6::DOUBLE + 0.15::DOUBLE * least(1.0::DOUBLE, n_amounts / 10.0::DOUBLE)) / 1.75::DOUBLE ELSE 0 END, 12) AS score FROM x),
q AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, chain_no)),
k AS (SELECT d.doc_id, chain_no, CASE WHEN chain_no IS NULL THEN 'NO_RECONCILED_CHAIN' WHEN score < 0.35 THEN 'INSUFFICIENT_DETAIL_EVIDENCE' WHEN score - next < 0.15 THEN 'AMBIGUOUS_RECONCILED_CHAINS' ELSE 'CLEAR_DETAIL_CHAIN' END AS reason FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN q ON q.doc_id = d.doc_id AND place = 1)
SELECT doc_id, reason, CASE WHEN reason = 'CLEAR_DETAIL_CHAIN' THEN 'selected' ELSE 'partial' END AS status, CASE WHEN reason = 'CLEAR_DETAIL_CHAIN' THEN chain_no END AS chain_no FROM k""")
def d14_selected(spark, sf_dir):
    """Of every statement, which chain of d8_chains' is selected, or why none is."""
    lines = _lines(spark, sf_dir)
    marked = lines.select("doc_id", "line_no", "dated", (F.size("money") > 0).alias("has_money"))
    return select.select_chains(select.evidence(settle(_chains(lines, Weights(max_states=BEAM))), marked), marked).select("doc_id", "reason", "status", "chain_no")
