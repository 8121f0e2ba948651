"""The pipeline's stages against plain Python, and the queries against their SQL."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


def test_pipeline_by_stages(spark):
    import corpus_pipeline as P
    from tests.llm.test_corpus import brute_groups, lower, split

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = docs.collect(), out.collect()
        ids = {r.doc_id for r in after}
        assert out.columns[: len(docs.columns)] == docs.columns and len(after) == len(ids)
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        elif name == "lines":
            assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)
        elif name == "near duplicates":
            groups = brute_groups([(r.doc_id, r.text, r.source) for r in before])
            assert ids == {i for (i, _), (_, g) in groups.items() if i == g}
        elif name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
            windows = {tuple(v[k : k + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for v in [words(r.text)] for k in range(max(1, len(v) - 12))}
            for r in before:
                w = words(r.text)
                hit = {p for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
                assert (r.doc_id in ids) == (not (hit and 20 * len(hit) >= len(w)))
        else:
            assert all(0 < r.taken <= 3 * len(split(r.text)) for r in after)
            for s in {r.source for r in after}:
                own = [r for r in after if r.source == s]
                assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        kept[name] = out
        docs = out
    assert sorted(r.doc_id for r in entry.queries()["pipeline"](spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_takes_odd_rows_and_columns(spark):
    """Nulls in any column, empty and blank texts, repeated rows and ids, other columns by the names used inside."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    rows = [(i, f"the house and the garden of number {i} " * (2 + i % 40), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, "en", "s0", None), (101, "", None, "s0", 0), (102, " \n ", "en", None, 3), (None, "the garden and the house of number nine " * 9, None, "s1", 5), (None, None, None, None, None), rows[0], rows[1], (3, "another text under the same number " * 8, "en", "s2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_text_md5", F.lit("x")).withColumn("taken", F.lit(-1)).withColumn("id", F.lit(1))
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.columns[: len(docs.columns)] == docs.columns and 0 < out.count() <= docs.count()
        if name == "language":
            assert out.where("text is null or trim(text) = ''").count() == 0 and out.where("doc_id is null").count() == 1
        docs = out
    empty = docs.where("false").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if k.startswith("op")])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    show = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(show(r) for r in df.collect()) == sorted(show([r[i] for i in order]) for r in want.fetchall())


def test_secrets_query_matches_brute_force(spark):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in entry.queries()["op7_find_secrets"](spark, SF).collect()}
    assert set(got) == set(texts)
    letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    keys = "|".join([letters(w) for w in ("password", "passwd", "secret", "token")] + [letters("api") + "_?" + letters("key")])
    for i, text in texts.items():
        found = [(m.start(), 0, m.end()) for m in re.finditer(rf"({keys})[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r.spans.split(",")) or not base


def test_language_query_on_held_out_documents(spark):
    import zlib

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op1_language_id"](spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held) and len(held) >= 30


def test_warc_query_reads_back_every_page(spark):
    import base64
    import hashlib

    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = entry.queries()["op4_warc_round_trip"](spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for i, b in pages.items()}
