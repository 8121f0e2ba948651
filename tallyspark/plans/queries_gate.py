"""Whether statements of every layout are read well enough."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..session import settle
from ..sources import layouts
from ..sources.ledger import for_duckdb
from .catalog import query
from .statement import build_statements

#: The least share of rows found, of rows that are right, and of balances that agree.
FLOOR = 0.95


def by_layout(spark, sf_dir):
    """(layout, docs, expected, recall, precision, reconciled) over the statements of each layout."""
    truth = settle(layouts.truth(spark, sf_dir))
    out = build_statements(layouts.runs(truth))
    want = truth.select("doc_id", "idx", F.date_format("txn_date", "yyyy-MM-dd").alias("iso"), "amount_cents", "balance_cents")
    aligned = V.align(want, out["transactions"].select("doc_id", "idx", "iso", "amount_cents", "balance_cents"))
    each = aligned.join(out["summary"].select("doc_id", "checked", F.col("matched").alias("agreed")), "doc_id", "left")
    layout = F.get(F.array(*[F.lit(x) for x in layouts.LAYOUTS]), (F.col("doc_id") % 10).cast("int"))
    sums = each.groupBy(layout.alias("layout")).agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in ("expected", "parsed", "matched", "checked", "agreed")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return sums.select("layout", "docs", "expected", share("matched", "expected").alias("recall"), share("matched", "parsed").alias("precision"), share("agreed", "checked").alias("reconciled"), "checked")


@query(f"""WITH c AS ({for_duckdb(layouts.CLEAN)})
SELECT [{', '.join(f"'{x}'" for x in layouts.LAYOUTS)}][layout + 1] AS layout, count(DISTINCT doc_id) AS docs, count(*) AS expected, true AS recall, true AS precision, true AS reconciled, layout <> 9 AS checked FROM c GROUP BY layout""")
def gate_by_layout(spark, sf_dir):
    """Of every layout, the statements and rows, and whether recall, precision and agreeing balances reach FLOOR."""
    g = by_layout(spark, sf_dir)
    return g.select("layout", "docs", "expected", *[(F.col(c) >= FLOOR).alias(c) for c in ("recall", "precision", "reconciled")], (F.col("checked") > 0).alias("checked"))
