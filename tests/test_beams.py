"""Documents searched side by side against the search as rows and the decoder's arrays."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import beams, decode, search

from .test_search import MONEY, decoded, documents, figures_without_spark


@pytest.mark.parametrize("most", [1, 3, 40, 40_000])
def test_side_by_side_as_alone(spark, most):
    """Steps, cut-off scores, best readings and chains are those of a document's own search, whatever documents share its arrays."""
    docs, w = documents(5, 60), decode.Weights(max_states=most)
    figures = search.figures_of(spark.createDataFrame([(d, 10 * k, line) for d, lines in docs.items() for k, line in enumerate(lines)], MONEY))
    out = search.search_together(figures, w)
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
        assert found.get(d, []) == [(c.opening, c.closing, [(x, at[k]) for _, x, k in c.amounts], [(at[a], at[b], x, y) for a, b, x, y, _, _ in c.constraints]) for c in chains]


def test_ranks_as_in_the_search_as_rows(spark):
    docs, w, rnd = documents(9, 40), decode.Weights(max_states=5), random.Random(1)
    figures = search.figures_of(spark.createDataFrame([(d, k, line) for d, lines in docs.items() for k, line in enumerate(lines)], MONEY)).cache()
    states = {(d, rnd.randint(1, 4), rnd.choice([None, 100, 200, 500, 555]), rnd.choice([0, 0, 100, -300])) for d in range(42) for _ in range(12)}
    watched = spark.createDataFrame(sorted(states, key=str), "doc_id long, step int, anchor long, total long")
    got, want = (sorted(map(str, f(figures, w, watched)["ranks"].collect())) for f in (search.search_together, search.search))
    assert got == want and sum("rank=None" not in r for r in got) > 30


def test_nothing_to_search(spark):
    out = search.search_together(search.figures_of(spark.createDataFrame([], MONEY)))
    assert out["trace"].count() == out["best"].count() == 0


def test_one_pass_saves_no_step(spark, monkeypatch):
    """However many lines a document has, one table is saved."""
    saved, settle = [], search.settle
    monkeypatch.setattr(search, "settle", lambda df: saved.append(settle(df)) or saved[-1])
    docs = documents(7, 20)
    figures = search.figures_of(spark.createDataFrame([(d, k, line) for d, lines in docs.items() for k, line in enumerate(lines)], MONEY))
    assert search.search_together(figures, decode.Weights(max_states=3))["trace"].agg(F.max("states")).first()[0] > 3 and len(saved) == 1


def test_documents_stay_whole_however_lines_come_in_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(search, "GATHERED", 7)
    ids = [1] * 3 + [2] * 20 + [5] + [6] * 2 + [9] * 8
    for size in (1, 4, 9, 50):
        tables = list(search.whole_documents(pa.record_batch({"doc_id": ids[k : k + size]}) for k in range(0, len(ids), size)))
        held = [t["doc_id"].to_pylist() for t in tables]
        assert sum(held, []) == ids and all(a[-1] != b[0] for a, b in zip(held, held[1:], strict=False))
    assert [(p.start, p.stop) for p in search.parts(__import__("numpy").array(ids), 2)] == [(0, 23), (23, 26), (26, 34)]


def test_sums_beyond_64_bits_are_refused():
    import numpy as np

    big = {"value": np.array([1 << 60]), "size": np.array([1 << 60]), "has_sign": np.array([False]), "confidence": np.ones(1), "support": np.ones(1), "eligible": np.array([True])}
    with pytest.raises(ArithmeticError):
        beams.Beams(np.array([0]), np.array([0]), big, decode.Weights())


def statements(seed, n):
    """Figures of statements as they are printed: some balances are missing or off, some amounts have the wrong sign or none."""
    rnd, out = random.Random(seed), []
    figure = lambda token, value, sign, confidence, support: {"token": token, "value": value if sign or value > 0 else -value, "size": abs(value), "has_sign": sign and value < 0, "confidence": confidence, "support": support}
    for _ in range(n):
        balance, lines, scale = rnd.randrange(-(10**6), 10**6), [], rnd.choice([9, 10**3, 10**7])
        for k in range(rnd.randint(1, 9)):
            amount = rnd.randrange(1, scale) * rnd.choice([-1, 1])
            balance += amount
            line = [figure(1000 * k, -amount if rnd.random() < 0.1 else amount, rnd.random() < 0.7, rnd.choice([0.775, 1.0]), rnd.choice([2 / 3, 1.0]))]
            if rnd.random() < 0.85 and balance:
                line.append(figure(1000 * k + 1, balance + 10_000 * (rnd.random() < 0.1), True, 1.0, 1.0))
            lines.append(line + ([figure(1000 * k + 2, 100, False, 0.3, 0.0)] if k % 4 == 3 else []))
        out.append(lines)
    return out


@pytest.mark.parametrize("most", [1, 12, 30, 200])
def test_what_a_narrow_beam_settles_is_the_result_of_the_wide_one(most):
    """Chains, competing ones, their order and the score; what may differ is left to a wider beam."""
    found = 0
    for w in (decode.Weights(max_states=most + 1), decode.Weights(max_states=5 * most), decode.Weights(max_states=3_000)):
        given = figures_without_spark(21, 40) + statements(most, 60)
        given = [lines for lines in given if lines]
        for lines, got in zip(given, beams.settled(given, w, most), strict=True):
            found += got is not None
            assert got is None or got == decode.decode(lines, w)[:3]
    assert found > (0 if most == 1 else 30)


def test_most_statements_are_settled_by_narrow_beams(monkeypatch):
    """The wide beam is for few; what it would give is the same."""
    wide, plain = [], beams.decode
    monkeypatch.setattr(beams, "decode", lambda lines, w: wide.append(lines) or plain(lines, w))
    given, w = statements(3, 60), decode.Weights(max_states=4_000)
    assert beams.decoded(given, w) == [plain(lines, w)[:3] for lines in given] and len(wide) < 12
    big = [[{"token": 0, "value": 1 << 70, "size": 1 << 70, "has_sign": False, "confidence": 1.0, "support": 1.0}]]
    assert beams.decoded([big], w) == [plain(big, w)[:3]]


def test_workers_decode_without_a_copy_of_the_package(tmp_path):
    """Executors have no tallyspark to import; the decoder reaches them by value, with all that it calls."""
    import subprocess
    import sys

    import pyarrow as pa
    from pyspark import cloudpickle

    money = [{"value": v, "magnitude": v, "has_sign": False, "confidence": 1.0, "support": 1.0} for v in (1000.0, 25.0, 1025.0)]
    row = {"doc_id": 1, "lines": [{"line_no": 0, "money": money[:1]}, {"line_no": 1, "money": money[1:]}]}
    here = [b.to_pylist() for b in decode._decode_batches(decode.Weights(), beams.decoded, iter([pa.RecordBatch.from_pylist([row])]))]
    (tmp_path / "job").write_bytes(cloudpickle.dumps((decode._decode_batches, beams.decoded, decode.Weights(), row)))
    code = "import pickle, sys, pyarrow as pa; f, d, w, row = pickle.load(open('job', 'rb')); print([b.to_pylist() for b in f(w, d, iter([pa.RecordBatch.from_pylist([row])]))]); assert 'tallyspark' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert done.returncode == 0 and done.stdout.strip() == str(here), done.stderr
