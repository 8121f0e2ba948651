"""The search as rows against the decoder's arrays, and clusters against a plain fold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import decode, search
from tallyspark.operators.cluster import clustered

MONEY = "doc_id long, line_no long, money array<struct<value:double,magnitude:double,has_sign:boolean,confidence:double,support:double>>"


def documents(seed, n):
    """Lines of a few figures whose sums meet often; some lines have none, some more figures than may have roles."""
    rnd, out = random.Random(seed), {}
    for d in range(n):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            few = rnd.choice([0, 1, 1, 2, 2, 2, 6 if d % 9 == 0 else 2])
            figures = []
            for _ in range(few):
                cents = rnd.choice([100, 200, 300, 400, 500, 700])
                sign = rnd.random() < 0.3
                figures.append({"value": -cents / 100 if sign else cents / 100, "magnitude": cents / 100, "has_sign": sign, "confidence": rnd.choice([0.3, 0.6, 0.75, 1.0]), "support": rnd.choice([0.0, 1 / 3, 1.0])})
            lines.append(figures)
        out[d] = lines
    return out


def decoded(lines, w, trace):
    given = [[{"token": k * 1000 + i, "value": round(m["value"] * 100), "size": round(m["magnitude"] * 100), **{c: m[c] for c in ("has_sign", "confidence", "support")}} for i, m in enumerate(line)] for k, line in enumerate(lines) if line]
    return decode.decode(given, w, trace=trace)


@pytest.mark.parametrize("most", [3, 40_000])
def test_the_search_equals_the_decoder(spark, most):
    docs, w = documents(5, 60), decode.Weights(max_states=most)
    figures = search.figures_of(spark.createDataFrame([(d, 10 * k, line) for d, lines in docs.items() for k, line in enumerate(lines)], MONEY))
    out = search.search(figures, w)
    trace = {(r.doc_id, r.step): (r.states, r.cutoff) for r in out["trace"].collect()}
    best = {r.doc_id: r for r in out["best"].collect()}
    found: dict = {}
    for r in search.chains(out["best"], figures).orderBy("doc_id", "chain_no").collect():
        found.setdefault(r.doc_id, []).append((r.opening_cents, r.closing_cents, [(a.cents, a.line_no) for a in r.amounts], [(c.from_line, c.to_line, c.from_cents, c.to_cents) for c in r.constraints]))
    for d, lines in docs.items():
        if not any(lines):
            assert d not in best
            continue
        steps: list = []
        chains, _, score, pruned = decoded(lines, w, steps)
        at = [10 * k for k, line in enumerate(lines) if line]
        assert [trace[d, k + 1] for k in range(len(steps))] == [(n, pytest.approx(cut) if cut is not None else None) for n, cut in steps]
        assert (best[d].score, best[d].pruned) == (pytest.approx(score), pruned)
        want = [(c.opening, c.closing, [(x, at[k]) for _, x, k in c.amounts], [(at[a], at[b], x, y) for a, b, x, y, _, _ in c.constraints]) for c in chains]
        assert found.get(d, []) == want


def test_ranks_of_watched_states(spark):
    one = {"magnitude": 1.0, "has_sign": False, "confidence": 1.0, "support": 1.0}
    figures = search.figures_of(spark.createDataFrame([(1, 0, [{"value": 1.0, **one}]), (1, 1, [{"value": 1.0, **one}])], MONEY))
    watched = spark.createDataFrame([(1, 1, None, 0), (1, 1, 100, 0), (1, 2, None, 200), (1, 2, 555, 0), (9, 1, None, 0)], "doc_id long, step int, anchor long, total long")
    got = {(r.doc_id, r.step, r.anchor, r.total): r.rank for r in search.search(figures, watched=watched)["ranks"].collect()}
    # An amount costs 1.5, a chain 4, an unexplained figure 8; only a chain that ends at the second figure is ahead of two amounts.
    assert got == {(1, 1, None, 0): 4, (1, 1, 100, 0): 3, (1, 2, None, 200): 2, (1, 2, 555, 0): None, (9, 1, None, 0): None}


def test_no_documents(spark):
    out = search.search(search.figures_of(spark.createDataFrame([], MONEY)))
    assert out["trace"].count() == out["best"].count() == 0


def fold(values, tolerance):
    out, total, n, g = [], 0.0, 0, -1
    for v in values:
        if n and abs(v - total / n) <= tolerance:
            total, n = total + v, n + 1
        else:
            total, n, g = v, 1, g + 1
        out.append(g)
    return out


def test_clusters_equal_a_plain_fold(spark):
    rnd = random.Random(4)
    rows = [(k, float(rnd.choice([rnd.randrange(40), 0.5 * rnd.randrange(60), 7 * rnd.randrange(9)])), i) for k in range(40) for i in range(rnd.randrange(1, 60))]
    got = clustered(spark.createDataFrame(rows, "k int, v double, i int"), ["k"], "v", 2.0, ["i"]).collect()
    for k in range(40):
        mine = sorted((r.v, r.i, r.cluster) for r in got if r.k == k)
        assert [c for _, _, c in mine] == fold([v for v, _, _ in mine], 2.0) and len(mine) == sum(r[0] == k for r in rows)


def test_a_long_document_takes_linear_time(spark):
    """A million values under one key, in pairs and columns that gaps cut, and a dense stretch that they don't."""
    n = 1_000_000
    v = F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 4) * 10.0).when(F.col("id") % 1000 == 1, -1e6 + F.col("id") * 0.0015).otherwise(-1e7 + 50.0 * (F.col("id") % 8))
    took = []
    for size in (n // 4, n):
        rows = spark.range(size).select(F.lit(1).alias("k"), v.alias("v"), "id")
        began = time.perf_counter()
        top = clustered(rows, ["k"], "v", 2.0, ["id"]).agg(F.count("*"), F.max("cluster")).first()
        took.append(time.perf_counter() - began)
        assert top[0] == size and top[1] > size // 4
    assert took[1] < 12 * took[0] + 5


def test_steps_save_only_the_states_that_go_on(spark, monkeypatch):
    """What the beam drops is written nowhere, and what a step saved goes once the next one has been saved."""
    docs, w, saved, gone = documents(7, 20), decode.Weights(max_states=3), [], []
    settle, forget = search.settle, search.forget
    monkeypatch.setattr(search, "settle", lambda df: saved.append(settle(df)) or saved[-1])
    monkeypatch.setattr(search, "forget", lambda df: gone.append((df, df.groupBy("doc_id").count().agg(F.max("count")).first()[0])) or forget(df))
    out = search.search(search.figures_of(spark.createDataFrame([(d, k, line) for d, lines in docs.items() for k, line in enumerate(lines)], MONEY)), w)
    steps = max(sum(map(bool, lines)) for lines in docs.values())
    assert out["trace"].agg(F.max("states")).first()[0] > 3
    assert len(gone) == steps and all(most <= 3 for _, most in gone) and len(saved) == 1 + 2 * steps


def figures_without_spark(seed, n):
    given = lambda lines: [[{"token": k * 1000 + i, "value": round(m["value"] * 100), "size": round(m["magnitude"] * 100), **{c: m[c] for c in ("has_sign", "confidence", "support")}} for i, m in enumerate(line)] for k, line in enumerate(lines) if line]
    return [given(a + b) for a, b in zip(documents(seed, n).values(), documents(seed + 1, n).values(), strict=True)]


@pytest.mark.parametrize("most", [1, 2, 7, 60, 400])
def test_rows_that_cannot_be_kept_change_nothing(most):
    """A trace counts all states, so it reads all rows; without one only the rows that may be kept are read. States, their order and their ways are the same."""
    for lines in figures_without_spark(11, 60):
        w = decode.Weights(max_states=most)
        some, every = decode.Beam(lines, w), decode.Beam(lines, w)
        for number, figures in enumerate(lines):
            (few, a), (states, b) = some.step(figures, number), every.step(figures, number, count=True)
            assert a == b and few in (None, states) and (few is not None or states > most)
            assert all((some.now[k] == every.now[k]).all() for k in every.now)
            assert all((x == y).all() for x, y in zip(some.trail[-1], every.trail[-1], strict=True))
        assert decode.decode(lines, w) == decode.decode(lines, w, trace=[])


def test_a_full_beam_reads_few_more_rows_than_it_keeps(monkeypatch):
    """Two figures on a line give each of 2,000 states nine readings without a chain; most can't be among the best 2,000."""
    read, merged = [], decode.Beam._merged
    monkeypatch.setattr(decode.Beam, "_merged", lambda self, s: read.append(len(s["key"])) or merged(self, s))
    rnd = random.Random(3)
    figure = lambda k: {"token": k, "value": (v := rnd.randrange(1, 10**9)), "size": v, "has_sign": False, "confidence": 1.0, "support": 1.0}
    lines = [[figure(1000 * k), figure(1000 * k + 1)] for k in range(12)]
    decode.decode(lines, decode.Weights(max_states=2_000))
    assert max(read) < 10_000


def test_a_balance_like_a_day_and_month_stands_in_the_search(spark, tmp_path):
    """12.05 beside a full date is a balance: steps, ranks and chains are those of the SQL."""
    import datetime
    import duckdb

    from tallyspark.plans import catalog

    cents = [(1, 100_000), (2, -98_795), (3, 250_000), (4, 3_000), (6, 40_000)]
    rows = [(k, 1, "F" if c < 0 else "O", abs(c) / 100, datetime.datetime(1996, 1, 13 + k)) for k, c in cents]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 0.0)], "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("d16_search_trace", "o11_watched_ranks", "d8_chains"):
        want = con.execute(catalog.oracle_sql()[name]).fetchall()
        assert want and sorted(map(str, (tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_short_documents_lose_none_with_few_figures(spark):
    """What counts as an amount beyond doubt is read as one figure, and only documents with more of those than asked for go."""
    from tallyspark.operators import tokens

    sure = ["1,234.56", "-1,234.56", "(1,234,567.89)", "12,34,567.89", "-1.234,56", "1.234.567,89", "1,234.56 CR", "12,34,567.89 DR"]
    doubtful = ["12.05", "13/01/1996", "Page 3", "Payment to P1234", "1234", "123.45", "1,234", "1.234", "01.02.1996", "-5"]
    rows = [(d, 1, k, text, 40.0, 100.0 + 13 * k, 5.0 * len(text), 9.0) for d, texts in enumerate([sure, doubtful * 3, sure[:3] + doubtful, sure + ["9,999.99"]]) for k, text in enumerate(texts)]
    runs = spark.createDataFrame(rows, "doc_id long, page int, ord long, str string, x double, y double, w double, h double")
    found = tokens.money_candidates(tokens.tokenise(runs.where("doc_id = 0")).join(tokens.metrics(runs), "doc_id"))
    assert sorted(r.ord for r in found.collect()) == list(range(len(sure)))
    short = tokens.short_documents(runs, 8)
    assert sorted(r.doc_id for r in short.select("doc_id").distinct().collect()) == [0, 1, 2]
    assert short.count() == len(sure) + 3 * len(doubtful) + 3 + len(doubtful)
