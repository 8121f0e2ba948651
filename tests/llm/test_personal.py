"""Personal data: base spans against plain patterns, the learning against plain Python, and the defined cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import personal as P


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    """Base spans by the patterns as they are stated, leftmost and greedy."""
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def expected(text):
    spans = plain(text)
    n = Counter(k for k, _, _ in spans)
    written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(written.encode()).hexdigest(), written


def strange(seed, count):
    rnd = random.Random(seed)
    bits = ["a@b.c", "@", ".", "a", "_", "x.y", "1", "12", "255", "256", "0", "001", "-", " ", "  ", "+1", "+", "(", ")", "4111111111111111", "4111 1111-1111 1111", "é", "😀", "\n", "9" * 25, "1.2.3.4", "+49 (30) 123-4567", "..", "b@c", "%", "5500000000000004"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 25))) for _ in range(count)]


def test_base_spans_equal_plain_patterns(spark):
    texts = [None, "", " ", *strange(1, 1500), "x" * 2000, "9" * 2000 + "." * 3, "a.b@c.d " * 700 + "1.2.3.4 " * 300, "+1 " * 500, "0" * 600 + ".1.1.1", "a@" * 3000, "1 " * 2000]
    rows = [(k, t, "src", k) for k, t in enumerate(texts)] + [(None, "me@x.org", "src", 0), (3, texts[3], "src", 0)]
    out = P.find_personal(spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email long").repartition(6))
    got = {r["id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    for k, t in enumerate(texts):
        r = got[k]
        base = ",".join(x for x in r["spans"].split(",") if x.split(":")[0] in P.BASE)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], base) == expected(t), t[:200]
    assert got[None]["spans"] == "email:0:8"


def test_very_long_texts(spark):
    texts = {"x" * 3000000: "", "9" * 1000000 + "...": "", "0" * 1000000 + ".1.1.1": "ip:0:1000006", "a@" * 500000: "", "1 " * 500000: "", "a.b@c.d " * 100000: None, "A" * 1000000: "", "Aa " * 300000: None, "+1 " * 300000: ""}
    began = time.perf_counter()
    out = P.find_personal(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(9)).collect()
    assert time.perf_counter() - began < 60
    for r in out:
        text, want = list(texts.items())[r["id"]]
        assert r["spans"] == want if want is not None else r["n_email"] == text.count("@")
        if "@c.d" in text:
            assert r["spans"].split(",")[-1] == "email:799992:799999"


def corpus(seed):
    """(text, spans that are personal) with candidates of either kind."""
    rnd, out = random.Random(seed), []
    number = lambda: f"{rnd.randint(201, 799)}-{rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
    given, family = ["Mary", "John", "Hans", "Carmen", "Emily"], ["Kowalski", "Brown", "Ibsen", "Ortega"]
    fillers = ["the report was sent out", "prices went up again", "nothing else was said about it", "we saw rain and wind"]
    for _ in range(500):
        parts, truth, text = [], [], ""
        for _ in range(rnd.randint(1, 4)):
            kind = rnd.randrange(8)
            lead, value, good = {
                0: ("please call my mobile ", number(), True), 1: ("order no ", f"{rnd.randint(200, 999)} {rnd.randint(100, 999)} {rnd.randint(100, 999)}", False),
                2: ("Social security number: ", f"{rnd.randint(100, 600)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", True), 3: ("serial part no ", f"000-{rnd.randint(10, 99)}-0000", False),
                4: ("regards, ", f"{rnd.choice(given)} {rnd.choice(family)}", True), 5: ("", f"The {rnd.choice(family)}", False),
                6: ("she was born on ", f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.{rnd.randint(1930, 2005)}", True), 7: ("version released ", f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.{rnd.randint(2001, 2020)}", False),
            }[kind]
            text += rnd.choice(fillers) + ". " + lead
            if good:
                truth.append((len(text), len(text) + len(value)))
            text += value + " . "
            parts.append(kind)
        out.append((text + ("mail me@x.org" if 0 in parts else ""), truth))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    texts = corpus(7)
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    return texts, {r["id"]: r["added"] for r in P.find_personal(rows).collect()}


def test_added_spans_are_found_and_clean_texts_left_alone(learned):
    texts, added = learned
    want = {(k, *s) for k, (_, truth) in enumerate(texts) for s in truth}
    got = {(k, x["start"], x["end"]) for k, xs in added.items() for x in xs}
    assert len(want & got) / len(want) > 0.95
    assert len(want & got) / len(got) > 0.95


def test_licenses_and_sentences_are_no_names(spark):
    texts = ["Licensed under the Apache License, Version 2.0. Write to me@x.org, He The at thonble.", "GNU General Public License, call +1 (884) 555-3918", "my name is Mary Brown"] * 3
    out = P.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["id"] % 3: [x["kind"] for x in r["added"]] for r in out} == {0: [], 1: [], 2: ["name"]}


def test_learning_equals_plain_python(spark):
    rnd = random.Random(2)
    patterns = Counter()
    for _ in range(3000):
        truth, kind = rnd.random() < 0.3, rnd.randrange(len(P.SHAPES))
        votes = [3 * j + 1 + (0 if rnd.random() < 0.4 else (1 if truth else -1) * (1 if rnd.random() < 0.6 + 0.06 * j else -1)) for j in range(len(P.LABELERS))]
        patterns[(*votes, P.VOTES + kind)] += 1
    table = spark.createDataFrame([(list(k), n) for k, n in patterns.items()], "features array<int>, n long")
    got = P.reliabilities(table, rounds=6)

    w = [0.8 * (f % 3 - 1) if f < P.VOTES else -0.5 for f in range(P.FEATURES)]
    for _ in range(6):
        yes, every = [0.0] * P.FEATURES, [0] * P.FEATURES
        for k, n in patterns.items():
            p = 1 / (1 + math.exp(-sum(w[f] for f in k)))
            for f in k:
                yes[f] += n * p
                every[f] += n
        y, t = sum(yes[P.VOTES : P.VOTES + len(P.SHAPES)]), sum(patterns.values())
        w = [math.log((yes[f] + 1 + f % 3) / (y + 6)) - math.log((every[f] - yes[f] + 3 - f % 3) / (t - y + 6)) if f < P.VOTES else math.log((yes[f] + 1) / (every[f] - yes[f] + 2)) if f < P.VOTES + len(P.SHAPES) else -0.5 for f in range(P.FEATURES)]
    assert max(abs(a - b) for a, b in zip(got, w, strict=True)) < 1e-9
    better = [got[3 * j + 2] - got[3 * j] for j in range(len(P.LABELERS))]
    assert better[-1] > better[0] > 0  # the better a labeler, the more its votes weigh

    trained = P.classifier(table, P.chance(P.weighed(F.col("features"), got)))
    share = lambda w, k: 1 / (1 + math.exp(-sum(w[f] for f in k)))
    wrong = sum(n for k, n in patterns.items() if (share(trained, k) > 0.5) != (share(got, k) > 0.5))
    assert wrong < 0.03 * 3000


def test_shapes(spark):
    cases = {
        "spelled_email": ["jo.doe [at] mail (dot) example.com", "x(at)y.org"], "national_id": ["123-45-6789"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], "local_phone": ["(030) 123 4567", "988-555-2485", "(988) 555-2485"],
        "birth_date": ["1.2.1990", "1990-02-01", "01/02/1990"], "address": ["12 Long Hill Road", "7 Elm St"], "name": ["Mary Brown", "Dr. Jane Q. Doe", "Jürgen Müller-Lüdenscheidt"],
    }
    rows = spark.createDataFrame([(k, f"{t} ") for k, ts in cases.items() for t in ts], "kind string, t string")
    found = rows.select("kind", "t", P.kind_of(F.trim("t")).alias("k"), P.located(F.col("t"), P.CANDIDATE, True).alias("at")).collect()
    for r in found:
        assert list(P.SHAPES)[r["k"]] == r["kind"] and [(x["start"], x["text"]) for x in r["at"]] == [(0, r["t"].strip())], r
    none = spark.createDataFrame([("987654-321 1234567-89-0 A12 v1.2.3.4.5 3.1.2 ISBN 0-306-40615-2 word Word",)], "t string").select(P.located(F.col("t"), P.CANDIDATE).alias("at")).first()
    assert not none["at"]
    ibans = spark.createDataFrame([("DE89 3704 0044 0532 0130 00", 1), ("GB82WEST12345698765432", 1), ("DE89 3704 0044 0532 0130 01", 0)], "t string, good int")
    assert all((r["m"] == 1) == bool(r["good"]) for r in ibans.select("good", P.rests(F.col("t")).alias("m")).collect())


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.find_personal(none).count() == 0
    out = P.find_personal(spark.createDataFrame([(1, "all lower case"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r["id"], r["spans"], len(r["added"])) for r in out) == [(1, "", 0), (2, "", 0)]


def test_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, "me@x.org")], "doc_id long, text string")
    shown = docs.select(P.candidates(F.col("text"), F.lit(True)), *P.base_spans(F.col("text")).values())._jdf.queryExecution().toString()
    assert "Python" not in shown and "Arrow" not in shown
