"""The decoder's decisions on whole statements, and the counts of its steps."""

import datetime
import random

from tallyspark.operators import decode
from tallyspark.plans import catalog


def tables(spark, folder, cents, opening=0.0):
    """orders and customer of one account for each list of amounts."""
    rows = [(1000 * d + k, d, "F" if c < 0 else "O", abs(c) / 100, datetime.datetime(1996, 1, 14 + i)) for d, amounts in cents.items() for i, (k, c) in enumerate(amounts)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(d, opening) for d in cents], "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_every_statement_gets_its_whole_decision(spark, tmp_path):
    """A row for each statement: which chain, all that competed with their evidence and columns, and what the selected one holds."""
    sf = tables(spark, tmp_path, {2: [(1, 100_000), (2, -23_456), (3, 78_900), (5, 50_011), (6, 91_234), (7, -12_345)], 3: [(1, 123_456)]}, 10.0)
    got = {r.doc_id: r for r in catalog.queries()["d14_decoded_statements"](spark, sf).collect()}
    assert sorted(got) == [2, 3]
    one = got[2]
    assert (one.status, one.reason, one.chain_no) == ("selected", "CLEAR_DETAIL_CHAIN", 0)
    assert (one.opening_cents, one.closing_cents, [a.cents for a in one.amounts], len(one.constraints)) == (101_000, 285_344, [-23_456, 78_900, 50_011, 91_234, -12_345], 4)
    assert one.candidates[0].chain_no == 0 and one.candidates[0].entries == 5 and len(one.candidates[0].columns) == 1
    scores = [c.detail_score for c in one.candidates]
    assert scores == sorted(scores, reverse=True) and (len(scores) < 2 or one.score_gap == scores[0] - scores[1])
    assert (got[3].status, got[3].reason, got[3].candidates, got[3].amounts) == ("partial", "NO_RECONCILED_CHAIN", [], None)


def test_states_are_counted_unless_that_is_not_asked_for():
    rnd = random.Random(3)
    figure = lambda k: {"token": k, "value": (v := rnd.randrange(1, 10**6)), "size": v, "has_sign": False, "confidence": 1.0, "support": 1.0}
    lines = [[figure(10 * k), figure(10 * k + 1)] for k in range(5)]
    told, untold = decode.Beam(lines, decode.Weights(max_states=20)), decode.Beam(lines, decode.Weights(max_states=20))
    for n, figures in enumerate(lines):
        states, cutoff = told.step(figures, n)
        assert untold.step(figures, n, count=False)[1] == cutoff and (cutoff is None) == (states <= 20)
        assert all((told.now[k] == untold.now[k]).all() for k in told.now)
