"""The engine's expressions and plans on vectors and small statements; the queries against their SQL are in test_queries."""

import io
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import amounts, cells, dates, locales
from tallyspark.operators import decode, evaluate, layout, reconcile, select, tokens
from tallyspark.plans.statement import build_statements, line_dates
from tallyspark.sources import exports, ofx, reports
from tallyspark.sources import runs as sources


def one(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.parametrize("text,cents", [("48'671.25", 4867125), ("(1,234.50)", -123450), ("1.234,56 DR", -123456), ("$ 5", 500), ("R$ 5,00", 500), ("12.00-", -1200), ("−3,5", -350), ("23.05.", None), ("x", None), ("", None), (None, None), ("US$5", None), ("1" * 41, None)])
def test_amounts(spark, text, cents):
    got = one(spark, [text], "string", amounts.parse_amount)[0]
    assert (got and got.cents) == cents


def test_dates(spark):
    texts = ["2025-01-31", "13/04/2025", "04/13/25", "31.12", "23.05.", "01. Okt 2021", "Mär 3, 2021", "30/02/2024", "--02", "1/2/123", None, " 3  août  99 "]
    assert [d and d.iso for d in one(spark, texts, "string", lambda c: dates.parse_date(c, "MDY"))] == ["2025-01-31", "2025-04-13", "2025-04-13", "--12-31", "--05-23", "2021-10-01", "2021-03-03", None, None, None, None, "1999-08-03"]
    assert one(spark, ["02/03/2025"], "string", lambda c: dates.parse_date(c, "DMY"))[0].iso == "2025-03-02"
    assert one(spark, ["--02-31", "2025-02-03", "odd", None], "string", lambda c: dates.format_date(c, "DD-MMM-YYYY", 2024)) == ["31-Feb-2024", "03-Feb-2025", "odd", ""]


def test_months_in_every_language(spark):
    names = [(n, m) for m, names in dates.MONTHS.items() for n in names.split()]
    assert one(spark, [n.title() for n, _ in names], "string", dates.month_number) == [m for _, m in names]


def test_cells(spark):
    texts = ["12.11", "12,11", "-12.11", "31/12/2024", "1234", "12", "Rent", "", None, "€5"]
    assert one(spark, texts, "string", cells.classify) == ["date", "money", "money", "date", "money", "weak_number", "text", "text", "text", "money"]


def test_splitting(spark):
    texts = ["01. Okt 2021 Miete -790,00", "plain", "Coffee  shop 1,234.56", ""]
    runs = spark.createDataFrame([(i, t, 0.0, float(len(t))) for i, t in enumerate(texts)], "i int, str string, x double, w double")
    got = [r.cells for r in cells.split_runs(runs).orderBy("i").collect()]
    assert [[p.str for p in x] for x in got] == [["01. Okt 2021", "Miete", "-790,00"], ["plain"], ["Coffee  shop", "1,234.56"], [""]]
    assert [p.x for p in got[0]] == [0.0, 12.0, 19.0] and [p.w for p in got[2]] == [13.0, 8.0]


def test_locales(spark):
    assert len(locales.MARKETS) == 17 and locales.market("zz").code == "en-US" and len(locales.markets_of("de")) == 3
    m = locales.market("fr-FR")
    assert one(spark, [123456789, -5, 0, None], "long", lambda c: locales.display_amount(exports.money(c), m.decimal, m.thousands, False)) == ["1\u202f234\u202f567,89", "-0,05", "", ""]
    assert one(spark, ["a;b", 'q"q', "a,b", None], "string", lambda c: locales.csv_field(c, ";")) == ['"a;b"', '"q""q"', "a,b", ""]


def test_a_wrong_balance_breaks_two_links_and_flags_are_idempotent(spark):
    rows = spark.createDataFrame([(1, i, 100, b, []) for i, b in enumerate([1000, 1100, 9999, 1300, 1400])], "doc_id long, idx long, amount_cents long, balance_cents long, flags array<string>")
    s = reconcile.summary(rows).first()
    assert (s.checked, s.matched, [m.idx for m in s.mismatches]) == (4, 2, [2, 3])
    twice = reconcile.flag_mismatches(reconcile.flag_mismatches(rows)).orderBy("idx").collect()
    assert [r.flags for r in twice] == [[], [], ["balance-mismatch"], ["balance-mismatch"], []]


def statement(rows, date=lambda i: f"{i + 13:02d}/04/2025", notes=()):
    """Runs of a page: heading, rows (amount, balance) and second lines."""
    out, y = [("Date", 42, 100), ("Description", 112, 100), ("Amount", 400, 100), ("Balance", 493, 100)], 120
    for i, (amount, balance) in enumerate(rows):
        out += [(date(i), 42, y), (f"Shop number {i}", 112, y), (amount, 430 - 5 * len(amount), y)] + ([(balance, 528 - 5 * len(balance), y)] if balance else [])
        if i in notes:
            y += 11
            out.append(("card ending 99", 112, y))
        y += 14
    return [(7, 1, k, s, float(x), float(y), 5.0 * len(s), 9.0) for k, (s, x, y) in enumerate(out)]


RUNS = "doc_id long, page int, ord long, str string, x double, y double, w double, h double"


def test_statement(spark):
    runs = spark.createDataFrame(statement([("-10.00", "1,990.00"), ("(5.00)", "1,985.00"), ("1.015,00", "3,000.00"), ("20.00", "2,980.00")], notes={1}), RUNS)
    got = build_statements(runs)
    rows = got["transactions"].orderBy("idx").collect()
    assert [r.amount_cents for r in rows] == [-1000, -500, 101500, -2000] and rows[3].flags == ["sign-corrected"]
    assert rows[0].iso == "2025-04-13" and rows[1].description == "Shop number 1 card ending 99" and rows[1].flags == ["multiline-description"]
    s = got["summary"].first()
    assert (s.reading, s.checked, s.matched, s.sign_corrections, s.quality, s.badge) == ("by headings", 3, 3, 1, "ok", "ok")
    assert got["warnings"].first().warnings == []


def test_statement_without_balances_and_empty_input(spark):
    got = build_statements(spark.createDataFrame(statement([("10.00", None), ("20.00", None), ("-30.00", None)], date=lambda i: f"0{i + 1}/02/2025"), RUNS))
    s = got["summary"].first()
    assert s.checked == 0 and s.n_rows == 3 and set(got["warnings"].first().warnings) == {"date-order-ambiguous", "no-balance-column"}
    assert all(df.count() == 0 for df in build_statements(spark.createDataFrame([], RUNS)).values())


def test_text_too_thin_is_refused(spark):
    got = build_statements(spark.createDataFrame([(1, 1, 0, "hello", 1.0, 1.0, 5.0, 9.0)], RUNS))
    assert got["summary"].first().quality == "needs_ocr" and got["transactions"].count() == 0
    assert sources.guards(spark.createDataFrame([(1, 1, 0, "hello", 1.0, 1.0, 5.0, 9.0)], RUNS)).first().error == "NO_TEXT_LAYER"


def test_joined_text_keeps_split_numbers_together(spark):
    runs = spark.createDataFrame([(1, 1, k, s, x, 10.0, w, 10.0) for k, (s, x, w) in enumerate([("1,2", 10.0, 15.0), ("34.50", 25.2, 25.0), ("CR", 60.0, 10.0)])], RUNS)
    assert layout.build_rows(runs).first().text == "1,234.50 CR"


OFX = "OFXHEADER:100\n<OFX><STMTRS><CURDEF>EUR<BANKID>1<ACCTID>2<BANKTRANLIST><STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20250102<TRNAMT>-1,000.50<NAME>A &amp;lt; B<STMTTRN><TRNTYPE>INT<DTPOSTED>2025<TRNAMT>x</BANKTRANLIST><LEDGERBAL><BALAMT>99.50</LEDGERBAL></STMTRS></OFX>"


def test_ofx(spark):
    files = spark.createDataFrame([(1, OFX), (2, "<OFX></OFX>"), (3, OFX + OFX)], "doc_id long, content string")
    rows = ofx.transactions(files).orderBy("doc_id", "statement", "idx").collect()
    assert [(r.doc_id, r.amount_cents, r.balance_cents, r.description, r.iso) for r in rows[:2]] == [(1, -100050, 9950, "A < B", "2025-01-02"), (1, 0, 9950, "Interest", None)]
    assert rows[1].flags == ["no-date"] and len({(r.doc_id, r.statement) for r in rows}) == 3
    said = {r.doc_id: r for r in ofx.statements(files).collect()}
    assert said[1].account == "1 2" and said[2].warnings == ["no-transactions", "no-ledger-balance"]


def test_workbook(spark):
    rows = spark.createDataFrame([(1, 0, "2025-01-31", "A & <B>", None, 500, 500, 1000, ["multiline-description"], 1, "31/01", "raw"), (1, 1, "--02-01", "C", 200, None, -200, 799, ["x"], 1, None, "raw")], "doc_id long, idx long, iso string, description string, debit_cents long, credit_cents long, amount_cents long, balance_cents long, flags array<string>, page int, date_raw string, raw_text string")
    book = zipfile.ZipFile(io.BytesIO(exports.workbook(exports.workbook_rows(rows).collect(), [("Source file", "s.pdf"), ("Rows", 2)], "DD.MM.YYYY")))
    first, raw = book.read("xl/worksheets/sheet1.xml").decode(), book.read("xl/worksheets/sheet3.xml").decode()
    assert "A &amp; &lt;B&gt;" in first and "<v>45688</v>" in first and "<v>36557</v>" in first and "multiline" not in first and "0.01" in raw
    assert "dd.mm.yyyy" in book.read("xl/styles.xml").decode()


def test_reports(spark, tmp_path):
    now = spark.createDataFrame([(1, 2, 9, 0.5, 3, "ok")], "doc_id long, pages int, n_rows long, pass_rate double, checked long, quality string")
    base = reports.baseline(now, spark.createDataFrame([(2, "NO_TEXT_LAYER")], "doc_id long, reason string"))
    assert reports.regressions(base, base).count() == 0 and reports.regressions(base, base.withColumn("rows", F.col("rows") + 1)).count() == 1
    reports.write_artifacts(base, f"{tmp_path}/a")
    with pytest.raises(Exception):
        reports.write_artifacts(base, f"{tmp_path}/a")
    with pytest.raises(ValueError):
        reports.write_artifacts(base.withColumn("description", F.lit("x")), f"{tmp_path}/b")


def test_records_are_written_whole_or_not_at_all(spark, tmp_path):
    from tallyspark.sources.records import read_records, write_records

    rows = spark.range(40, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é\u2028\n"), F.col("id"))).alias("status"), (F.col("id") / 7).alias("rate"), (F.col("id") % 2 == 0).alias("publishable"))
    write_records(rows, f"{tmp_path}/r")
    back = read_records(spark, f"{tmp_path}/r")
    assert back.schema.simpleString() == rows.schema.simpleString() and sorted(back.collect()) == sorted(rows.collect())
    # Files whose range of ids holds none that a filter asks for are not opened.
    for some, n, files in (("doc_id = 11", 1, 1), ("doc_id > 18", 21, 3), ("doc_id in (1, 35)", 2, 2), ("doc_id >= 0 and status is null", 14, 4), ("doc_id = 99", 0, 0)):
        found = back.where(some)
        assert found.count() == n and len(found.select(F.spark_partition_id()).distinct().collect()) == min(files, n) and found.rdd.getNumPartitions() == max(files, 1)
    before = {f.name for f in (tmp_path / "r").iterdir()}
    with pytest.raises(Exception, match="already"):
        write_records(rows, f"{tmp_path}/r")
    assert {f.name for f in (tmp_path / "r").iterdir()} == before
    # A task that fails leaves nothing, nor do those that were through before it.
    broken = rows.withColumn("rate", F.when(F.col("doc_id") == 39, F.raise_error(F.lit("no"))).otherwise(F.col("rate")))
    with pytest.raises(Exception, match="no"):
        write_records(broken, f"{tmp_path}/b")
    assert not list((tmp_path / "b").glob("**/*.jsonl")) and not list((tmp_path / "b").glob("run-*/*"))
    write_records(rows.where("doc_id < 0"), f"{tmp_path}/e")
    assert read_records(spark, f"{tmp_path}/e").count() == 0
    for odd in (rows.withColumn("d", F.current_date()), rows.drop("doc_id")):
        with pytest.raises(Exception, match="records"):
            write_records(odd, f"{tmp_path}/o")


def test_totals_are_counted_while_rows_pass(spark, tmp_path):
    summary = spark.createDataFrame([(k, 1, 3 + k, 0.9 + k / 100, 4, "ok" if k % 2 else "low_confidence") for k in range(8)], "doc_id long, pages int, n_rows long, pass_rate double, checked long, quality string")
    report, totals = reports.with_totals(reports.verify_report(summary))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("totals"))
    spark.sparkContext.setJobGroup("totals", "")
    report.write.parquet(f"{tmp_path}/t")
    once = jobs()
    assert totals.get == {"documents": 8, "rows": 52, "checked": 32, "publishable": 3, "doubtful": 4} and jobs() == once
    spark.sparkContext.setJobGroup("", "")


def test_visual_lines_against_a_walk_through_the_tokens(spark):
    from tallyspark.operators.tokens import visual_lines

    rng = random.Random(5)
    rows = [(d, p, o, 0, f"t{o}", float(rng.randrange(0, 60)), rng.randrange(0, 120) / 2, 13.0) for d in range(4) for p in (1, 2) for o in range(rng.choice((1, 25)))]
    got = visual_lines(spark.createDataFrame(rows, "doc_id long, page int, ord long, n int, text string, x double, y double, pitch double")).collect()
    want = []
    for d, p in sorted({r[:2] for r in rows}):
        page, held, lines = [r for r in rows if r[:2] == (d, p)], set(), []
        for r in page:
            if r[2] not in held:
                line = sorted((o for o in page if abs(o[6] - r[6]) <= 6.5), key=lambda o: (o[5], o[2]))
                held |= {o[2] for o in line}
                lines.append((line[0][6], r[2], [o[4] for o in line]))
        want += [(d, p, *line) for line in sorted(lines)]
    assert [(r.doc_id, r.page, r.y, r.seed_ord, [t.text for t in r.tokens]) for r in sorted(got, key=lambda r: (r.doc_id, r.line_no))] == want


def figure(k, value, signed=False, support=1.0, confidence=0.9):
    return {"token": k, "value": value, "size": abs(value), "has_sign": signed, "confidence": confidence, "support": support}


def exhaustive(lines, w):
    """The best score of all readings, without merging or pruning."""
    level = [decode.State()]
    for n, figures in enumerate(lines):
        best5 = {m["token"] for m in sorted(figures, key=lambda m: -m["confidence"])[: w.roles_per_line]}
        for m in figures:
            level = [s for old in level for s in decode._choices(old, n, m, w, m["confidence"] >= w.least_confidence and m["token"] in best5)]
    return max(s.score for s in level)


def test_decoder_finds_the_chain():
    lines = [[figure(0, 100000)], [figure(1, 2500), figure(2, 97500)], [figure(3, 4000), figure(4, 101500)], [figure(5, 12345, confidence=0.3)]]
    chains, _, score, late = decode.decode(lines)
    assert len(chains) == 1 and not late
    assert (chains[0].opening, chains[0].closing, [a[1] for a in chains[0].amounts]) == (100000, 101500, [-2500, 4000])
    assert score == pytest.approx(exhaustive(lines, decode.Weights()))


def test_decoder_against_all_readings():
    rng = random.Random(8)
    for _ in range(25):
        balance, lines, k = 5000, [[figure(0, 5000)]], 1
        for _ in range(3):
            amount = rng.choice([-700, 300, 1200])
            balance += amount
            row = [figure(k, abs(amount), support=1.0)]
            if rng.random() < 0.7:
                row.append(figure(k + 1, balance, support=1.0))
            lines.append(row)
            k += 2
        # Merged states forget the support of their spans; with equal support nothing is lost.
        assert decode.decode(lines)[2] == pytest.approx(exhaustive(lines, decode.Weights()))


def test_the_beam_is_as_wide_as_asked_for():
    """As a search over plain states, with and without states dropped, and in pieces."""
    rng = random.Random(5)
    for most, rows in ((7, 1 << 20), (24, 16), (10**6, 1 << 20), (10**6, 16)):
        w = decode.Weights(max_states=most)
        lines = [[figure(10 * n + k, rng.choice([-1, 1]) * rng.randint(1, 9) * 100, rng.random() < 0.3, rng.choice([0.4, 1.0]), rng.choice([0.5, 0.7, 0.9])) for k in range(rng.randint(1, 3))] for n in range(5)]
        beam, trace = [decode.State()], []
        for n, figures in enumerate(lines):
            level = beam
            for m in figures:
                level = [s for old in level for s in decode._choices(old, n, m, w, m["confidence"] >= w.least_confidence)]
            found = {}
            for s in level:
                if (s.anchor, s.total) not in found or s.score > found[s.anchor, s.total].score:
                    found[s.anchor, s.total] = s
            beam = sorted(found.values(), key=lambda s: -s.score)
            trace.append((len(beam), beam[most - 1].score if len(beam) > most else None))
            beam = beam[:most]
        arrays = decode.Beam(lines, w)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(decode, "ROWS", rows)
            assert [arrays.step(figures, n) for n, figures in enumerate(lines)] == trace
        for k in range(min(50, len(beam))):
            got = arrays.state(k, lines)
            assert (got.anchor, got.total, got.score, decode.chains_of(got)) == (beam[k].anchor, beam[k].total, beam[k].score, decode.chains_of(beam[k]))


def test_the_catalogue_decodes_with_the_whole_beam(spark):
    from tallyspark.operators import tokens
    from tallyspark.plans import catalog, queries_tokens

    sf = "/root/testdata/sf0.001"
    want = decode.decode_documents(tokens.build_lines(queries_tokens._tokens(spark, sf)), decode.Weights(max_states=40_000)).select("doc_id", "chain_no", "alternative", "opening_cents", "closing_cents", F.size("amounts"), F.size("constraints"))
    assert sorted(map(tuple, catalog.queries()["d8_decode"](spark, sf).collect())) == sorted(map(tuple, want.collect()))


def test_decoder_reads_all_lines_however_long_it_takes(monkeypatch):
    import itertools
    import time

    hours = itertools.count(0, 3600)
    monkeypatch.setattr(time, "monotonic", lambda: float(next(hours)))
    chains = decode.decode([[figure(0, 100000)], [figure(1, 2500), figure(2, 97500)], [figure(3, 4000), figure(4, 101500)]])[0]
    assert [(c.opening, c.closing) for c in chains] == [(100000, 101500)]


def test_trace_does_not_change_the_result():
    lines = [[figure(0, 1000)], [figure(1, 50), figure(2, 1050)]]
    trace = []
    assert decode.decode(lines, trace=trace)[2] == decode.decode(lines)[2] and len(trace) == 2 and trace[0][0] == 4


def test_selection(spark):
    lines = spark.createDataFrame([(d, i, d != 3 and i % 2 == 0, True) for d in (1, 2, 3, 4) for i in range(6)], "doc_id long, line_no long, dated boolean, has_money boolean")
    amount = lambda *ls: [(l, 100) for l in ls]  # noqa: E731, E741
    chains = spark.createDataFrame(
        [(1, 0, amount(0, 2, 4), [(True,)]), (1, 1, amount(1, 3), [(True,)]), (2, 0, amount(0, 2), [(True,)]), (2, 1, amount(2, 4), [(True,)]), (3, 0, amount(1), [(True,)]), (4, 0, amount(0), [(False,)])],
        "doc_id long, chain_no int, amounts array<struct<line_no:long,cents:long>>, constraints array<struct<passed:boolean>>",
    )
    got = {r.doc_id: (r.status, r.reason, r.chain_no) for r in select.select_chains(select.evidence(chains, lines), lines).collect()}
    assert got == {1: ("selected", "CLEAR_DETAIL_CHAIN", 0), 2: ("partial", "AMBIGUOUS_RECONCILED_CHAINS", None), 3: ("partial", "INSUFFICIENT_DETAIL_EVIDENCE", None), 4: ("partial", "NO_RECONCILED_CHAIN", None)}


def test_alignment_is_greedy(spark):
    kind = "doc_id long, idx long, iso string, amount_cents long, balance_cents long"
    want = spark.createDataFrame([(1, 0, "a", 100, 10), (1, 1, "b", 200, 20), (1, 2, "c", 300, 30), (2, 0, "a", 1, 1)], kind)
    got = spark.createDataFrame([(1, 0, "b", 101, 99), (1, 1, "b", 0, 21), (1, 2, "c", 7, 99), (3, 0, "z", 5, 5)], kind)
    r = {x.doc_id: x for x in evaluate.align(want, got).collect()}
    assert (r[1].matched, r[1].amount_mismatches, r[1].missing, r[1].extra) == (2, 1, 0, 0)
    assert (r[2].recall, r[2].precision, r[2].missing) == (0.0, 0.0, 1) and (r[3].recall, r[3].extra) == (1.0, 1)


def test_streams(spark, tmp_path):
    from tallyspark.streaming.statements import arriving_files, drained, incremental_chain, ingest

    kind = "doc_id long, idx long, amount_cents long, balance_cents long"

    def arrive(name, *batches):
        """Batches of rows as files, a batch each, older ones first."""
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in{k}")
            for f in (tmp_path / name / f"in{k}").glob("*.parquet"):
                os.utime(f, (1000 + k, 1000 + k))
        return spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    # The third row waits for the second; a repeated number is late; a balance or an amount that is null is not checked.
    source = arrive("a", [(1, 1, 5, 100), (1, 3, 5, 999)], [(2, 1, 1, None), (1, 4, None, 7)], [(1, 2, 5, 105), (1, 2, 6, 1)], [(1, 1, 0, 0), (2, 2, 1, 2), (3, 2, 1, 1)])
    got = {(r.doc_id, r.idx, r.late): (r.previous, r.agrees) for r in drained(incremental_chain(source), f"{tmp_path}/out").collect()}
    second = got.pop((1, 2, False))
    assert second[0] == 100 and got.pop((1, 2, True)) == (None, None)
    third = got.pop((1, 3, False))
    assert third in ((105, False), (1, False))
    assert got == {(1, 1, False): (None, None), (1, 4, False): (999, None), (1, 1, True): (None, None), (2, 1, False): (None, None), (2, 2, False): (None, None)}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.ofx").write_text(OFX)
    seen = []
    q = ingest(arriving_files(spark, f"{tmp_path}/files"), lambda batch, n: seen.extend(ofx.transactions(batch.selectExpr("1 as doc_id", "cast(content as string) as content")).collect()), f"{tmp_path}/c2")
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 2


def test_a_stream_stops_waiting_for_missing_rows(spark, tmp_path):
    from tallyspark.streaming.statements import incremental_chain, state_store

    kind = "doc_id long, idx long, amount_cents long, balance_cents long"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, 1, 5, 100), (1, 3, 5, 105), (1, 4, 1, 106)])
    stream = incremental_chain(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), patience_ms=100)
    with state_store(spark):
        q = stream.writeStream.format("memory").queryName("gaps").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    until = time.monotonic() + 60
    while spark.table("gaps").count() < 3 and time.monotonic() < until:
        time.sleep(0.2)
    put([(1, 2, 0, 100), (1, 5, 1, 107)])
    while spark.table("gaps").count() < 5 and time.monotonic() < until:
        time.sleep(0.2)
    q.stop()
    got = {r.idx: (r.previous, r.agrees, r.late) for r in spark.table("gaps").collect()}
    assert got == {1: (None, None, False), 3: (100, True, False), 4: (105, True, False), 2: (None, None, True), 5: (106, True, False)}


def test_site_checks(spark):
    paths = evaluate.served(spark.createDataFrame([("/a/index.html",), ("/b.html",)], "path string"))
    assert {r.path for r in paths.collect()} == {"/a/index.html", "/a/", "/b.html", "/b"}
    links = spark.createDataFrame([("p", "/a"), ("p", "/b#x"), ("p", "/c"), ("p", "http://x")], "page string, href string")
    assert {(r.href, r.needs_slash) for r in evaluate.broken_links(links, paths).collect()} == {("/a", True), ("/c", False)}


def test_small_amounts_beside_a_date_are_no_dates(spark):
    """12.05 is a day and a month, unless the row has a date beyond doubt; by itself it stays one."""
    cells_of = [(1, 1, 1, "03/02/2025", 40.0, 100.0, 50.0, 9.0), (1, 1, 2, "Coffee", 100.0, 100.4, 30.0, 9.0), (1, 1, 3, "12.05", 400.0, 99.8, 25.0, 9.0), (1, 1, 4, "11.12", 40.0, 113.0, 25.0, 9.0), (1, 1, 5, "1,200.00", 400.0, 113.0, 40.0, 9.0)]
    runs = spark.createDataFrame(cells_of, RUNS)
    rows = layout.build_rows(runs).orderBy("row_no").collect()
    assert [[(c.str, c.kind, c.fields is not None) for c in r.cells] for r in rows] == [[("03/02/2025", "date", True), ("Coffee", "text", False), ("12.05", "money", False)], [("11.12", "date", True), ("1,200.00", "money", False)]]
    t = tokens.tokenise(runs).join(tokens.metrics(runs), "doc_id")
    assert {r.text for r in tokens.money_candidates(t).collect()} == {"12.05", "1,200.00"}
    assert sorted(r.iso for r in line_dates(t).collect()) == ["--12-11", "2025-02-03"]


def test_partitions_are_fine_unless_the_session_says_otherwise(spark):
    """Sorted cells take many times the room of their shuffled form, so tasks are of 8 MB, as many as it takes."""
    from tallyspark import session

    finest, task = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    at_first = spark.conf.get(finest, None), spark.conf.get(task)
    try:
        spark.conf.set(finest, "7")
        spark.conf.set(task, "1m")
        layout.build_rows(spark.createDataFrame([(1, 1, 1, "x", 0.0, 10.0, 5.0, 9.0)], RUNS))
        assert (spark.conf.get(finest), spark.conf.get(task)) == ("7", "1m")
        spark.conf.unset(finest)
        layout.build_rows(spark.createDataFrame([(1, 1, 1, "x", 0.0, 10.0, 5.0, 9.0)], RUNS))
        assert (spark.conf.get(finest), spark.conf.get(task)) == (str(session.FINEST), f"{session.TASK_BYTES}b")
    finally:
        for key, value in zip((finest, task), at_first):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_rows_are_dealt_out_by_document_once_and_plain_texts_meet_no_dictionary(spark):
    """between runs and marked rows lie a shuffle by document and the three of the texts that may have parts."""
    runs = spark.createDataFrame([(d, p, k, text, 40.0 + 90 * k, 100.0 + 13 * k, 5.0 * len(text), 9.0) for d in range(3) for p in (1, 2) for k, text in enumerate(["13/01/2025", "Rent paid", "1,234.50", "1,200.00 CR"])], RUNS)
    rows = layout.table_window(layout.furniture(layout.build_rows(runs)))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    by_document = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(doc_id" in x]
    assert len(by_document) == 1 and "Union" in plan
    assert {r.text: [c.kind for c in r.cells] for r in rows.collect()} == {"13/01/2025": ["date"], "Rent paid": ["text"], "1,234.50": ["money"], "1,200.00 CR": ["money"]}


def test_clusters_gathered_are_those_of_single_items(spark):
    import random

    from tallyspark.operators.cluster import clustered, gathered, middle

    rnd = random.Random(9)
    items = spark.createDataFrame([(k, float(rnd.choice([rnd.randrange(30), 0.5 * rnd.randrange(60)])), i) for k in range(30) for i in range(rnd.randrange(1, 40))], "k int, v double, i int")
    want = {}
    for r in clustered(items, ["k"], "v", 2.0, ["i"]).collect():
        want.setdefault((r.k, r.cluster), []).append((r.v, r.i))
    got = gathered(items, ["k"], "v", 2.0, ["i"], ["v", "i"]).select("k", "segment", "part", "items", middle(F.transform("items", lambda x: x["v"])).alias("m")).orderBy("k", "segment", "part").collect()
    place: dict = {}
    for r in got:
        place[r.k] = place.get(r.k, -1) + 1
        assert [(x.v, x.i) for x in r["items"]] == sorted(want.pop((r.k, place[r.k])))
        v = sorted(x.v for x in r["items"])
        assert r.m == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert not want


def test_what_is_told_from_amounts_and_dates_early(spark):
    """What no amount or date looks like goes by one search; what may be one stays."""
    money = {"USD 5.00": 500, "HK$5.00": 500, "(1,234.50)": -123450, "5.00 CR": 500, "−5.00": -500, "1 234,50 €": 123450, "CHF 1’234.50 DR": -123450, "Page 3": None, "12/05/1996": None, "5.00_": None, "5:00": None}
    assert one(spark, list(money), "string", lambda c: amounts.parse_amount(c)["cents"]) == list(money.values())
    days = {"5 May 2025": "2025-05-05", "05/04/2025": "2025-04-05", "2025-04-05": "2025-04-05", "5.4.": None, "Paid May 5": None, "1,234.50": None, "5. März 2025": "2025-03-05", "12.05": "--05-12"}
    assert one(spark, list(days), "string", lambda c: dates.parse_date(c, "DMY")["iso"]) == list(days.values())


def test_columns_are_found_from_a_small_part_of_the_rows(spark, monkeypatch):
    """what is saved on the way to columns holds places and kinds, neither texts of cells nor fields of dates."""
    saved = []
    monkeypatch.setattr(layout, "settle", lambda df: saved.append(df.schema.simpleString()) or df)
    runs = spark.createDataFrame([(1, 1, k, text, 40.0, 100.0 + 13 * k, 5.0 * len(text), 9.0) for k, text in enumerate(["13/01/2025", "14/01/2025", "Rent paid"])], RUNS)
    assert layout.detect_columns(layout.build_rows(runs)).selectExpr("size(date_bands) AS n", "table_left", "table_right").first() == (1, 40.0, 90.0)
    assert len(saved) == 1 and "fields" not in saved[0] and "cents" not in saved[0] and "text" not in saved[0]


def test_few_workbooks_are_held_at_a_time():
    """a batch of many statements gives its workbooks a few at a time, all of them and in order."""
    import pyarrow as pa

    row = {"idx": 0, "day": None, "description": "A", "debit": None, "credit": None, "amount": 1, "balance": None, "notes": "", "row_no": 1, "page": 1, "date_raw": "", "delta": "", "flags": "", "raw_text": ""}
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "rows": [row] * (d % 3 + 1)} for d in range(50)])
    out = list(exports.books(iter([batch]), "s.pdf", "YYYY-MM-DD"))
    assert max(b.num_rows for b in out) <= exports.BOOKS < 50
    assert [(d, n) for b in out for d, n in zip(b["doc_id"].to_pylist(), b["row_count"].to_pylist(), strict=True)] == [(d, d % 3 + 1) for d in range(50)]
    assert all(x[:2] == b"PK" for b in out for x in b["bytes"].to_pylist())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


TOKENS = "doc_id long, page int, ord long, n int, text string, x double, y double, x1 double, x2 double, pitch double"


def scattered(spark):
    rng = random.Random(3)
    rows = [(d, p, o, 0, f"t{o}", x, rng.randrange(-40, 60) / 2, x, x + 9.0, 13.0) for d in range(3) for p in (1, 2) for o in range(rng.choice((1, 30))) for x in [float(rng.randrange(0, 60))]]
    return rows, spark.createDataFrame(rows, TOKENS)


def test_pairs_of_tokens_are_those_of_all_against_all_and_need_no_shuffle(spark):
    """Pairs by bands equal a comparison of all tokens of a page; tokens that lie by document are shuffled no more on the way to neighbours."""
    rows, df = scattered(spark)
    pages = [(a, b) for a in rows for b in rows if a[:2] == b[:2]]
    pair = lambda df: sorted(map(tuple, df.select("doc_id", "page", "a.ord", F.col("b.ord").alias("other")).collect()))
    assert pair(tokens.same_baseline(df)) == sorted((*a[:3], b[2]) for a, b in pages if a[2] != b[2] and abs(a[6] - b[6]) <= 6.5)
    assert pair(tokens.stacked_below(df)) == sorted((*a[:3], b[2]) for a, b in pages if 0 < b[6] - a[6] <= 1.4 * 13.0 and b[7] < a[8] and b[8] > a[7])
    by_document = df.repartition("doc_id")
    assert exchanges(tokens.neighbours(tokens.same_baseline(by_document))) == exchanges(by_document) == 1
    assert exchanges(tokens.stacked_below(by_document).groupBy(*tokens.first()).count()) == 1


def test_visual_lines_need_no_shuffle(spark):
    """tokens that lie by document are shuffled no more on the way to lines; tokens without a height are on none."""
    _, df = scattered(spark)
    by_document = df.repartition("doc_id")
    assert exchanges(tokens.visual_lines(by_document)) == 1
    assert tokens.visual_lines(df.withColumn("y", F.lit(None).cast("double"))).count() == 0
