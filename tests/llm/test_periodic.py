"""Periodic runs against a brute-force search, and the defined cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from tallyspark.llm.periodic import Extensions, collapsed, periodic_runs, runs_of, text_runs
from tallyspark.llm.queries import planted


def brute(words, exponent=4, length=6):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(length, exponent * q):
                found.setdefault((start, i - start + q), q)  # a longer period of the same stretch is a multiple
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        k, out = rnd.choice([1, 2, 3]), []
        for _ in range(rnd.randrange(8)):
            unit = [rnd.randrange(k) for _ in range(rnd.randrange(1, 7))]
            out += unit * rnd.randrange(1, 7) + unit[: rnd.randrange(len(unit) + 1)] + [rnd.randrange(9)] * rnd.randrange(2)
        yield out


def test_runs_equal_brute_force():
    for words in sequences(3, 1500):
        text = [str(w).encode() for w in words]
        assert text_runs(text) == brute(words) == runs_of(words), words
        assert runs_of(words, 2, 2) == brute(words, 2, 2), words
        gone = {k for s, n, q in brute(words) for k in range(s + q, s + n)}
        assert collapsed(text, text_runs(text)) == [w for k, w in enumerate(text) if k not in gone]


def test_colliding_hashes_change_nothing():
    for words in sequences(5, 300):
        ext = Extensions(words)
        ext._alike = lambda i, j, size: True  # the worst hash there is
        for i in range(len(words) - 1, 0, -1):
            for j in range(i + 1, len(words)):
                size = next((m for m in range(len(words) - j) if words[i + m] != words[j + m]), len(words) - j)
                assert ext.forward(i, j) == size
                size = next((m for m in range(i) if words[i - m - 1] != words[j - m - 1]), i)
                assert ext.backward(i, j) == size


def test_periods_beyond_the_near_ones():
    rnd = random.Random(11)
    unit = [rnd.randrange(4) for _ in range(6000)]
    words = [9, 8, 7] + unit * 5 + unit[:77] + [5]
    assert [r for r in runs_of(words) if r[2] > 40] == [(3, 30077, 6000)]


def test_long_texts_take_linear_time():
    assert text_runs([b"a"] * 400000) == [(0, 400000, 1)]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300000:  # Fibonacci words hold no power above 3.7
        a, b = b, b + a
    assert text_runs(b) == []


def test_rows(spark):
    texts = [None, "", " \n\t ", "a b c", "x " * 9, "x " * 9, "p q r " * 4 + "z " + "m n " * 5, "p q " * 4 + "z " + "m n " * 4, "  a b " * 3, "w" * 200000 + " v" * 7]
    rows = [(k if k else None, t, "note", k) for k, t in enumerate(texts)]
    out = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, id string, n_runs long"))
    got = {r["collapsed_sha256"] + str(r["id"]): r for r in out.collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        r = got[hashlib.sha256(kept.encode()).hexdigest() + str(k if k else None)]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["collapsed"]) == (len(runs), *best, kept)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    assert periodic_runs(out.limit(0).selectExpr("id as doc_id", "collapsed as text")).count() == 0


def test_planted_repeats(spark):
    texts = [(k, f"one two three four five six seven eight nine ten {k}") for k in range(200)] + [(None, "a b"), (10, None), (22, " ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for row in planted(docs).collect():
        h = zlib.crc32(str(row.doc_id).encode())
        if row.doc_id is None or h % 10 or not (row.text or "").strip():
            assert (row.doc_id, row.text) in texts
            continue
        w, g = f"one two three four five six seven eight nine ten {row.doc_id}".split(), h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert row.text.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
