"""Queries of sources, gates, alignment and site checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.occupations import OCCUPATIONS, occupations
from ..operators import evaluate as V
from ..session import scratch, settle
from ..sources import runs as S
from ..sources.ledger import LEDGER, RUNS, for_duckdb, ledger, runs
from .catalog import query, table

L, R = f"l AS ({for_duckdb(LEDGER)})", f"r AS ({for_duckdb(RUNS)})"


@query(f"WITH {R} SELECT doc_id, count(DISTINCT page) AS pages, sum(length(trim(str)))::BIGINT AS chars, CASE WHEN count(DISTINCT page) > 3 THEN 'TOO_MANY_PAGES' WHEN sum(length(trim(str))) < 20 THEN 'NO_TEXT_LAYER' END AS error FROM r GROUP BY doc_id")
def s4_page_and_text_guards(spark, sf_dir):
    return S.guards(runs(spark, sf_dir), max_pages=3)


ERRORS = [("PasswordException", 1, "PASSWORD_NEEDED"), ("PasswordException", 2, "WRONG_PASSWORD"), ("InvalidPDFException", None, "INVALID_FILE"), ("MissingPDFException", None, "UNREADABLE"), ("Other", None, "Other"), ("x", 2, "WRONG_PASSWORD")]


@query("SELECT c_custkey, [" + ", ".join(f"'{m}'" for _, _, m in ERRORS) + f"][c_custkey % {len(ERRORS)} + 1] AS meaning FROM customer")
def s6_error_mapping(spark, sf_dir):
    """The failures of one reader for each customer."""
    one = lambda i: F.get(F.array(*[F.lit(e[i]) for e in ERRORS]), (F.col("c_custkey") % len(ERRORS)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.friendly_error(one(0), F.coalesce(one(1), F.lit(0))).alias("meaning"))


@query("SELECT doc_id, n_chars > 20000 AS refused FROM documents")
def s7_size_gate(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") * S.MAX_BYTES / 20000).alias("length"))
    return S.size_gate(files).select("doc_id", F.col("error").isNotNull().alias("refused"))


@query(f"WITH {R} SELECT doc_id, page, string_agg(str, ' ' ORDER BY ord) AS text, length(string_agg(str, ' ' ORDER BY ord))::INT AS chars, length(string_agg(str, ' ' ORDER BY ord)) > 100 AS text_layer FROM r GROUP BY ALL")
def s13_page_texts(spark, sf_dir):
    return S.page_texts(runs(spark, sf_dir))


def _truth(spark, sf_dir):
    return ledger(spark, sf_dir).select("doc_id", "idx", F.concat_ws("#", F.col("txn_date").cast("string"), "idx").alias("iso"), F.col("true_cents").alias("amount_cents"), "balance_cents", "okey")


@query(f"""WITH {L}, a AS (SELECT doc_id, count(*) AS expected, count(*) FILTER (okey % 19 <> 0) AS parsed, count(*) FILTER (okey % 19 = 0) AS missing FROM l GROUP BY doc_id)
SELECT doc_id, expected, parsed, parsed AS matched, missing, CASE WHEN parsed > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, parsed / expected::DOUBLE AS recall FROM a""")
def j11_alignment(spark, sf_dir):
    """A reading that loses every row with okey % 19 = 0 against the truth. Dates carry the row's number, so that no other row of a day stands in."""
    truth = _truth(spark, sf_dir)
    return V.align(truth, truth.where("okey % 19 <> 0")).select("doc_id", "expected", "parsed", "matched", (F.col("missing") + F.col("amount_mismatches")).alias("missing"), "precision", "recall")


@query(f"WITH {L}, k AS (SELECT doc_id, floor(amount_cents / 1000000)::BIGINT AS size, idx FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size ORDER BY idx) AS occurrence FROM k), m AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id, size ORDER BY idx) AS occurrence FROM k WHERE idx % 3 <> 0) SELECT doc_id, size, count(*) AS missing FROM n ANTI JOIN m USING (doc_id, size, occurrence) GROUP BY ALL")
def u4_bag_difference(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("doc_id", F.floor(F.col("amount_cents") / 1000000).alias("size"), "idx")
    return V.bag_difference(rows, rows.where("idx % 3 <> 0"), ["doc_id", "size"], ["idx"]).groupBy("doc_id", "size").agg(F.count("*").alias("missing"))


@query(f"""WITH {L}, c AS (SELECT doc_id, CASE WHEN okey % 2 = 0 THEN amount_cents + 1 ELSE amount_cents + 5 END AS cents, (okey % 10) / 10.0::DOUBLE AS confidence FROM l)
SELECT l.doc_id, l.idx, (SELECT max(confidence) FROM c WHERE c.doc_id = l.doc_id AND abs(abs(c.cents) - abs(l.amount_cents)) <= 1) AS confidence FROM l""")
def j13_found_amounts(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    found = rows.select("doc_id", F.when(F.col("okey") % 2 == 0, F.col("amount_cents") + 1).otherwise(F.col("amount_cents") + 5).alias("cents"), ((F.col("okey") % 10) / 10).alias("confidence"))
    return V.found_readings(rows.select("doc_id", "idx", F.col("amount_cents").alias("cents")), found).select("doc_id", "idx", "confidence")


@query("""SELECT c_custkey, bool_or(rate >= 0.95 AND n >= 3 AND issues <= 1) AS publishable FROM (SELECT c_custkey, unnest([0.9 + (c_custkey % 10) / 100.0, 0.99])::DOUBLE AS rate, unnest([c_custkey % 5, 3]) AS n, unnest([c_custkey % 3, c_custkey % 4]) AS issues FROM customer) GROUP BY c_custkey""")
def f14_publish_gate(spark, sf_dir):
    k = F.col("c_custkey")
    v = lambda rate, n, issues: F.struct(rate.alias("rate"), n.alias("rows"), F.array_repeat(F.lit("x"), issues.cast("int")).alias("issues"))
    records = F.array(v(0.9 + (k % 10) / 100, k % 5, k % 3), v(F.lit(0.99), F.lit(3).cast("long"), k % 4))
    return table(spark, sf_dir, "customer").select("c_custkey", V.publishable(records).alias("publishable"))


#: Links of the crawled pages, and a site made of the paths that even pages link to.
HREFS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"?#]*)"', 1)) AS href FROM pages), s AS (SELECT DISTINCT href AS path FROM h WHERE page_id % 2 = 0)"""


def _hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"?#]*)"'), F.lit(1))).alias("href"))


@query(f"WITH {HREFS} SELECT h.page_id AS page, h.href, count(*) AS n, EXISTS (SELECT 1 FROM s t WHERE t.path = h.href || '/') AS needs_slash FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = h.href) GROUP BY ALL")
def j14_broken_links(spark, sf_dir):
    links = _hrefs(spark, sf_dir)
    paths = links.where("page % 2 = 0").select(F.col("href").alias("path")).distinct()
    return V.broken_links(links, paths).groupBy("page", "href", "needs_slash").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT CASE p_partkey % 3 WHEN 0 THEN concat('/', p_size, '/index.html') WHEN 1 THEN concat('/', p_size, '.html') ELSE concat('/img/', p_partkey, '.png') END AS p FROM part)
SELECT DISTINCT path FROM (SELECT p AS path FROM f UNION ALL SELECT regexp_replace(p, 'index\\.html$', '') FROM f WHERE p LIKE '%/index.html' UNION ALL SELECT regexp_replace(p, '\\.html$', '') FROM f WHERE p LIKE '%.html' AND p NOT LIKE '%/index.html')""")
def u5_served_paths(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("/"), size, F.lit("/index.html"))).when(k % 3 == 1, F.concat(F.lit("/"), size, F.lit(".html"))).otherwise(F.concat(F.lit("/img/"), k.cast("string"), F.lit(".png")))
    return V.served(table(spark, sf_dir, "part").select(path.alias("path")))


@query("""WITH r AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 40 = 0 THEN concat('/', p_size, '/*') ELSE concat('/', p_name) END AS source FROM part), m AS (SELECT max(ord) AS last FROM r WHERE source NOT LIKE '%*%')
SELECT ord, source, 'hides-page' AS problem FROM r WHERE source IN (SELECT concat('/', p_name) FROM part WHERE p_partkey % 3 = 0) UNION ALL SELECT ord, source, 'splat-before-plain' FROM r, m WHERE source LIKE '%*%' AND ord < last""")
def j16_redirect_conflicts(spark, sf_dir):
    n = table(spark, sf_dir, "part")
    source = F.when(F.col("p_partkey") % 40 == 0, F.concat(F.lit("/"), F.col("p_size").cast("string"), F.lit("/*"))).otherwise(F.concat(F.lit("/"), F.col("p_name")))
    paths = n.where("p_partkey % 3 = 0").select(F.concat(F.lit("/"), F.col("p_name")).alias("path"))
    return V.redirect_conflicts(n.select(F.col("p_partkey").alias("ord"), source.alias("source")), paths)


@query("""WITH a AS (SELECT n_name AS key, concat('{n} of {', lower(left(n_name, 1)), '}') AS text, n_nationkey AS k FROM nation) SELECT key, CASE WHEN k % 5 = 0 THEN 'only-first' ELSE 'placeholders' END AS problem FROM a WHERE k % 5 = 0 OR k % 7 = 0""")
def u7_dictionary_gaps(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("{n} of {"), F.lower(F.left("n_name", F.lit(1))), F.lit("}"))
    a = n.select(F.col("n_name").alias("key"), text.alias("text"))
    b = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 7 == 0, "{n}").otherwise(text).alias("text"))
    return V.dictionary_gaps(a, b)


@query("SELECT count(*) AS verified, (SELECT count(*) FROM customer) - count(*) AS pending FROM customer WHERE c_custkey % 10 >= 5 AND c_custkey % 5 >= 3 AND c_custkey % 3 <= 1")
def u6_verified_and_pending(spark, sf_dir):
    k = F.col("c_custkey")
    record = F.array(F.struct((0.9 + (k % 10) / 100 + 1e-9).alias("rate"), (k % 5).alias("rows"), F.array_repeat(F.lit("x"), (k % 3).cast("int")).alias("issues")))
    gate = V.publishable(record)
    return table(spark, sf_dir, "customer").agg(F.count_if(gate).alias("verified"), F.count_if(~gate).alias("pending"))


@query("WITH o AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(OCCUPATIONS)) + f") t(n, code, title)) SELECT c_custkey, code, title FROM customer JOIN o ON n = c_custkey % {len(OCCUPATIONS)}")
def t10_occupations(spark, sf_dir):
    """A customer's occupation by its code."""
    codes = F.array(*[F.lit(c) for c, _ in OCCUPATIONS])
    people = table(spark, sf_dir, "customer").select("c_custkey", F.get(codes, (F.col("c_custkey") % len(OCCUPATIONS)).cast("int")).alias("code"))
    return people.join(F.broadcast(occupations(spark)), "code").select("c_custkey", "code", "title")  # a list of under 100 rows


K8 = f"""{L}, g AS (SELECT *, lag(balance_cents) OVER (PARTITION BY doc_id ORDER BY idx) AS previous FROM l),
s AS (SELECT doc_id, count(*) AS rows, count(*) FILTER (previous IS NOT NULL AND balance_cents IS NOT NULL) AS checked, count(*) FILTER (previous + amount_cents = balance_cents) AS matched FROM g GROUP BY doc_id),
b AS (SELECT *, CASE WHEN checked > 0 THEN matched / checked::DOUBLE ELSE 0 END AS r FROM s)"""


@query(f"WITH {K8} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'refused' ELSE 'parsed' END AS outcome, CASE WHEN doc_id % 10 = 0 THEN 'NO_TEXT_LAYER' END AS reason, CASE WHEN doc_id % 10 > 0 THEN rows END AS rows, CASE WHEN doc_id % 10 > 0 THEN floor(r * 10000 + 0.5::DOUBLE) / 10000 END AS rate, CASE WHEN doc_id % 10 > 0 THEN checked END AS checked FROM b")
def k8_baseline(spark, sf_dir):
    from ..operators import reconcile
    from ..sources.reports import baseline

    s = reconcile.summary(ledger(spark, sf_dir)).withColumn("pages", F.lit(1)).withColumn("quality", F.lit("ok"))
    return baseline(s.where("doc_id % 10 > 0"), s.where("doc_id % 10 = 0").select("doc_id", F.lit("NO_TEXT_LAYER").alias("reason"))).select("doc_id", "outcome", "reason", "rows", "rate", "checked")


def _report(spark, sf_dir):
    from ..operators import reconcile
    from ..sources.reports import verify_report

    return verify_report(reconcile.summary(ledger(spark, sf_dir)).withColumn("pages", F.lit(1)).withColumn("quality", F.lit("ok")))


K9 = f"{K8}, v AS (SELECT doc_id, rows, r AS rate, checked, checked > 0 AND r >= 0.95::DOUBLE AND rows >= 3 AS publishable FROM b)"


@query(f"WITH {K9} SELECT * FROM v")
def k9_verify_report(spark, sf_dir):
    return _report(spark, sf_dir).select("doc_id", "rows", "rate", "checked", "publishable")


@query(f"WITH {K9} SELECT count(*) AS documents, sum(rows)::BIGINT AS rows, sum(checked)::BIGINT AS checked, count(*) FILTER (publishable) AS publishable, 0::BIGINT AS doubtful FROM v")
def k9_observed_totals(spark, sf_dir):
    """K9: totals of the report, counted by the job that writes it."""
    from ..sources.records import write_records
    from ..sources.reports import with_totals

    report, totals = with_totals(_report(spark, sf_dir))
    with scratch(spark) as folder:
        write_records(report, folder)
        return spark.createDataFrame([totals.get])


@query(f"WITH {K9} SELECT doc_id, 1::BIGINT AS pages, rows, rate, checked, 'ok' AS quality, publishable FROM v")
def k10_records(spark, sf_dir):
    """The report of every statement, written as records and read back."""
    from ..sources.records import read_records, write_records

    with scratch(spark) as folder:
        write_records(_report(spark, sf_dir), folder)
        return settle(read_records(spark, folder).withColumn("pages", F.col("pages").cast("long")))


@query(f"WITH {L} SELECT doc_id, idx FROM l WHERE okey % 97 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) <= 300")
def f12_flagged_preview(spark, sf_dir):
    from ..sources.reports import preview

    flags = F.when(F.col("okey") % 97 == 0, F.array(F.lit("balance-mismatch"))).otherwise(F.array(F.lit("multiline-description")))
    return preview(ledger(spark, sf_dir).withColumn("flags", flags), flagged_only=True).select("doc_id", "idx")
