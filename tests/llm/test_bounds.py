"""Memory and time of single tasks, and results that must not depend on the order of rows."""

import random
import time

import pyarrow as pa

import corpus_pipeline
from tallyspark.llm import decontaminate, secrets


def test_decontamination_lets_texts_go():
    shared = decontaminate.windows([("q", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")])
    most = 0

    def batches():
        nonlocal most
        for k in range(400):
            text = "word " * 200000 + ("one two three four five six seven eight nine ten eleven twelve thirteen" if k % 50 == 0 else "")
            yield pa.RecordBatch.from_arrays([pa.array([text]), pa.array([k])], names=["text", "id"])
            most = max(most, pa.total_allocated_bytes())

    rows = [r for b in decontaminate._scan(shared, batches()) for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(400)) and [bool(r["starts"]) for r in rows] == [k % 50 == 0 for k in range(400)]
    assert most < 32 << 20, most  # the texts have 400 MB


def test_secret_spans_are_compared_in_order():
    rnd = random.Random(1)
    for _ in range(300):
        span = lambda k: (a := rnd.randrange(60), k, a + rnd.randrange(1, 9))
        base, more = sorted(span(0) for _ in range(rnd.randrange(8))), sorted(span(3) for _ in range(rnd.randrange(8)))
        assert secrets.apart(more, base) == [x for x in more if not any(a < x[2] and x[0] < b for a, _, b in base)]
    base = [(20 * k, 0, 20 * k + 9) for k in range(200000)]
    began = time.perf_counter()
    assert len(secrets.apart([(20 * k + 10, 3, 20 * k + 19) for k in range(200000)], base)) == 200000
    assert time.perf_counter() - began < 5


def test_near_duplicates_keep_one_row_whatever_their_order(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text, "en", f"s{k}", 1) for k in range(40)] + [(9, text, "en", "other", 1), (11, "quite another text of its own", "en", "s0", 1)]
    schema, seen = "doc_id long, text string, lang string, source string, n_chars long", set()
    for n in (1, 4, 7):
        random.Random(n).shuffle(rows)
        out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(n), "")
        seen.add(tuple(sorted((r["doc_id"], r["source"]) for r in out.collect())))
    assert seen == {((7, "s0"), (11, "s0"))}
