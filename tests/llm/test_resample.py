"""Importance resampling against plain Python, and the defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from tallyspark.llm import resample as R


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(docs, target, buckets=R.BUCKETS, min_words=20, share=5):
    s, t = (Counter(bucket(f, buckets) for _, x in rows for f in features(x)[1]) for rows in (docs, target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    out = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain(bucket(f, buckets)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["The", "of", "Zürich", "ñandú", "x1", "long" * 40, "q" * 62, "q" * 63, "q" * 64, "a", "b", "c", "日本"])
    return [(i, rnd.choice([" ", ", ", "\n", "-"]).join(word() for _ in range(rnd.randrange(0, 60)))) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_brute_force(spark):
    docs = corpus(1, 300) + [(None, None), (None, "a b c " * 10), (400, ""), (401, " .,- "), (402, "one"), (402, "two words"), (5, "a b c " * 10), (5, "a b c " * 10)]
    target = corpus(2, 20) + [(0, None), (1, "")]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, id string, weight int").repartition(5)
    for more in ({}, {"min_words": 2, "share": 40}, {"buckets": 7, "share": 100}):
        assert rows_of(R.resample(frame(docs), frame(target), **more)) == brute(docs, target, **more)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame(corpus(3, 30), "doc_id long, text string")
    assert R.resample(none, docs).count() == 0
    assert rows_of(R.resample(docs, none)) == brute(corpus(3, 30), [])
    assert rows_of(R.resample(docs.withColumn("text", R.F.lit(None).cast("string")), docs)) == brute([(i, None) for i, _ in corpus(3, 30)], corpus(3, 30))


def test_long_texts_are_read_in_pieces(monkeypatch):
    texts = [t for _, t in corpus(4, 40)] + [" ", None, "a " * 500, "b", "w" * 300 + " c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    gains = R.np.arange(97) ** 2 - 700
    whole = [b.to_pydict() for b in R._scored(gains, iter([batch]))]
    for row, text in enumerate(texts):
        assert whole[0]["weight"][row] == sum(int(gains[bucket(f, 97)]) for f in features(text)[1])
    counts = [b.to_pydict() for b in R._counted(97, iter([batch]))]
    for block in (1, 3, 40, 1000):
        monkeypatch.setattr(R, "BLOCK", block)
        assert [b.to_pydict() for b in R._scored(gains, iter([batch]))] == whole
        assert [b.to_pydict() for b in R._counted(97, iter([batch]))] == counts
    assert dict(zip(counts[0]["bucket"], counts[0]["n"], strict=True)) == Counter(bucket(f, 97) for t in texts for f in features(t)[1])


def test_ranks_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(corpus(6, 400), "doc_id long, text string")
    a = rows_of(R.resample(docs.repartition(1), docs.limit(10), min_words=1, share=50))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert rows_of(R.resample(docs.repartition(17), docs.limit(10), min_words=1, share=50)) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ranks = sorted(r[4] for r in a if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 100
