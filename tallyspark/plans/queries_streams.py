"""Queries over streams of given tables."""

from __future__ import annotations

from ..session import scratch, settle
from ..sources.ledger import ledger
from ..streaming.statements import drained, incremental_chain
from .catalog import query
from .queries_verify import CHAIN


@query(f"WITH {CHAIN} SELECT doc_id, idx, amount_cents, balance_cents, previous, CASE WHEN checked THEN agrees END AS agrees, false AS late FROM c")
def w1_rows_out_of_order(spark, sf_dir):
    """W1 by a stream in which every account's rows arrive in any order, over several batches; the SQL is that of the batch rule."""
    rows = ledger(spark, sf_dir).select("doc_id", "idx", "amount_cents", "balance_cents", "okey")
    with scratch(spark) as folder:
        rows.repartition(8, "okey").drop("okey").write.parquet(f"{folder}/arriving")
        arriving = spark.readStream.schema("doc_id long, idx long, amount_cents long, balance_cents long").option("maxFilesPerTrigger", 3).parquet(f"{folder}/arriving")
        return settle(drained(incremental_chain(arriving), folder))
