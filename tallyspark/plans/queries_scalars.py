"""Queries of scalar functions. Most render known values as text and read them back, so the SQL only states the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts as A
from ..functions import cells as C
from ..functions import dates as D
from ..functions import locales as M
from ..functions import text as X
from ..sources import exports as E
from ..sources import ofx as O
from ..sources.ledger import LEDGER, PRINTED, for_duckdb, grouped, indian, ledger, printed_rows
from .catalog import query, table

P = f"p AS ({for_duckdb(PRINTED)})"
L = f"l AS ({for_duckdb(LEDGER)})"


@query(f"WITH {P} SELECT doc_id, idx, amount_cents AS cents, abs(amount_cents) / 100.0::DOUBLE AS magnitude, amount_cents < 0 AS negative, true AS strong FROM p")
def e1_parse_amount(spark, sf_dir):
    rows = printed_rows(spark, sf_dir).select("doc_id", "idx", "amount_text")
    return X.through(rows, {"a": (F.col("amount_text"), A.AMOUNT_STEPS)}).select("doc_id", "idx", "a.cents", "a.magnitude", "a.negative", "a.strong")


#: Prices in cents, as text in three ways of grouping, and what they come to; SQL that Spark and DuckDB read alike.
PRICES = f"""SELECT o_orderkey AS k, o_orderdate, c, concat(CAST(CAST(floor(c / 100) AS BIGINT) AS VARCHAR(12)), '.', lpad(CAST(c % 100 AS VARCHAR(2)), 2, '0')) AS plain,
  CASE o_orderkey % 3 WHEN 0 THEN {grouped("c", ",", ".")} WHEN 1 THEN {grouped("c", ".", ",")} ELSE {grouped("c", "''", ".")} END AS written
FROM (SELECT *, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM {{orders}} orders) o"""
PRICED = f"r AS ({for_duckdb(PRICES)})"


def prices(spark, sf_dir):
    return spark.sql(PRICES, orders=table(spark, sf_dir, "orders"))


def _listed(values) -> str:
    """SQL for a list of texts; pick one by its place from 1 on."""
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def dealt(values, key):
    """One of values by key, as an expression."""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


@query(f"WITH {PRICED} SELECT k, CASE WHEN k % 11 <> 0 THEN plain END AS number FROM r")
def e2_plain_number(spark, sf_dir):
    """Every price, grouped in one of three ways, or with a letter in it."""
    r = prices(spark, sf_dir)
    return r.select("k", A.plain_number(F.when(F.col("k") % 11 == 0, F.concat("written", F.lit("x"))).otherwise(F.col("written"))).alias("number"))


#: What stands before and behind an amount, and the currency that it says.
MARKED = [("$", "", "USD"), ("R$ ", "", "BRL"), ("HK$", "", "HKD"), ("€ ", "", "EUR"), ("", " chf", "CHF"), ("USD ", "", "USD"), ("", "", None), ("₹", "", "INR"), ("NZ$ ", "", "NZD"), ("plain ", "", None)]


@query(f"WITH {PRICED} SELECT k, {_listed([c for _, _, c in MARKED])}[k % {len(MARKED)} + 1] AS currency FROM r")
def e3_currency(spark, sf_dir):
    """Every price with a symbol or code."""
    k = F.col("k")
    text = F.concat(dealt([a for a, _, _ in MARKED], k), F.col("written"), dealt([b for _, b, _ in MARKED], k))
    return prices(spark, sf_dir).select("k", A.currency(text).alias("currency"))


@query(f"WITH {L} SELECT doc_id, idx, CASE WHEN amount_cents % 100 = 0 THEN concat(amount_cents // 100, '.00') ELSE concat(CASE WHEN amount_cents < 0 THEN '-' ELSE '' END, abs(amount_cents) // 100, '.', lpad((abs(amount_cents) % 100)::VARCHAR, 2, '0')) END AS text FROM l")
def e4_decimal_text(spark, sf_dir):
    return ledger(spark, sf_dir).select("doc_id", "idx", A.decimal_text(E.money(F.col("amount_cents"))).alias("text"))


@query(f"""WITH {P} SELECT doc_id, idx, okey % 5 AS style, (15 + 40 + CASE WHEN amount_cents < 0 THEN 20 ELSE 0 END) / 100.0::DOUBLE AS confidence, true AS has_decimal, amount_cents < 0 AS has_sign FROM p""")
def e5_money_reading(spark, sf_dir):
    t = F.col("amount_text")
    rows = X.through(printed_rows(spark, sf_dir).select("doc_id", "idx", "okey", "amount_text"), {"a": (A.money_word(t), A.AMOUNT_STEPS), "d": (A.money_word(t), D.date_steps("DMY"))})
    r = A.money_reading(t, F.col("a"), F.col("d").isNotNull())
    return rows.select("doc_id", "idx", (F.col("okey") % 5).alias("style"), r.alias("r")).select("doc_id", "idx", "style", "r.confidence", "r.has_decimal", "r.has_sign")


@query("SELECT l_orderkey, l_linenumber, floor((l_extendedprice * (1 - l_discount) - 50000) * 100 + 0.5::DOUBLE)::BIGINT AS cents FROM lineitem")
def e6_round_to_cents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.cents(F.col("l_extendedprice") * (1 - F.col("l_discount")) - 50000).alias("cents"))


@query("""SELECT o_orderkey, o_orderkey >= 1000 AS bare, true AS fraction, false AS long_number, o_orderkey >= 1000 AS grouped FROM orders""")
def f2_amount_like(spark, sf_dir):
    k = F.col("o_orderkey")
    texts = {"bare": k.cast("string"), "fraction": F.concat(k.cast("string"), F.lit(".25")), "long_number": F.concat(F.lit("9"), F.lpad(k.cast("string"), 15, "0")), "grouped": F.format_string("%,d", k)}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[t.alias(name) for name, t in texts.items()])
    read = X.through(rows, {f"{name}_amount": (F.col(name), A.AMOUNT_STEPS) for name in texts})
    return read.select("o_orderkey", *[A.amount_like(F.col(name), F.col(f"{name}_amount")).alias(name) for name in texts])


DATES = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '--%m-%d') AS partial, year(o_orderdate)::INT AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders"""


@query(f"""WITH t AS ({DATES}) SELECT o_orderkey, form, CASE form WHEN 'partial' THEN partial WHEN 'with year' THEN strftime(make_date(2024, m::BIGINT, CASE WHEN m = 2 THEN least(d, 28) ELSE d END::BIGINT), '%Y-%m-%d') WHEN 'no date' THEN NULL ELSE iso END AS iso
FROM t, (SELECT unnest(['iso', 'slashes', 'dots', 'day name', 'name day', 'partial', 'with year', 'no date']) AS form) f""")
def e8_parse_date(spark, sf_dir):
    """Every order's date written in seven ways and read back; the first of a month 13 is no date."""
    day = F.col("o_orderdate").cast("date")
    on = lambda p: F.date_format(day, p)
    partial = F.when((F.month(day) == 2) & (F.dayofmonth(day) > 28), F.lit("28.02.")).otherwise(on("dd.MM."))
    ways = {
        "iso": (on("yyyy-MM-dd"), "MDY"), "slashes": (on("M/d/yyyy"), "MDY"), "dots": (on("dd.MM.yyyy."), "DMY"), "day name": (on("d MMM yyyy"), "MDY"), "name day": (on("MMMM d, yyyy"), "DMY"),
        "partial": (on("dd.MM."), "DMY"), "with year": (partial, "DMY", 2024), "no date": (on("yyyy-13-dd"), "MDY"),
    }
    written = F.array(*[F.struct(F.lit(form).alias("form"), text.alias("text"), F.lit(order).alias("order"), F.lit(year[0] if year else None).cast("int").alias("year")) for form, (text, order, *year) in ways.items()])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(written))
    # Few distinct texts: their frames are read once each, under whatever order a row has.
    read = X.read_once(rows, "text", {"f": D.FIELD_STEPS})
    return X.through(read, {"d": (F.col("f"), D.dated_steps(F.col("order"), F.col("year")))}).select("o_orderkey", "form", F.col("d.iso").alias("iso"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN month(o_orderdate) END::INT AS month FROM orders")
def e11_month_number(spark, sf_dir):
    """The month of every order by one of its names, with accents, capitals or a point; other words have none."""
    k, names = F.col("o_orderkey"), F.array(*[F.array(*[F.lit(n) for n in D.MONTHS[m].split()]) for m in range(1, 13)])
    own = F.get(names, F.month("o_orderdate") - 1)
    name = F.get(own, (k % F.size(own)).cast("int"))
    spelled = F.when(k % 13 == 0, "total").when(k % 3 == 0, F.initcap(name)).when(k % 3 == 1, F.concat(name, F.lit("."))).otherwise(F.translate(F.upper(name), "AEU", "ÀÉÛ"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.month_number(spelled).alias("month"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS f0, strftime(o_orderdate, '%d/%m/%Y') AS f1, strftime(o_orderdate, '%m/%d/%Y') AS f2, strftime(o_orderdate, '%d.%m.%Y') AS f3, strftime(o_orderdate, '%d-%b-%Y') AS f4,
  strftime(o_orderdate, '%d/%m/2000') AS partial, strftime(make_date(2000, month(o_orderdate), day(o_orderdate)), '%Y-%m-%d') AS day FROM orders""")
def e12_format_date(spark, sf_dir):
    iso, partial = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "--MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[D.format_date(iso, f).alias(f"f{i}") for i, f in enumerate(D.FORMATS)], D.format_date(partial, "DD/MM/YYYY").alias("partial"), D.to_date(partial).cast("string").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS own, false AS own_inherited, strftime(make_date(2024, month(o_orderdate), day(o_orderdate)), '%Y-%m-%d') AS taken, true AS inherited FROM orders")
def e19_date_reading(spark, sf_dir):
    words = {"a": F.date_format("o_orderdate", "dd/MM/yyyy,"), "b": F.date_format("o_orderdate", "dd/MM;")}
    return X.through(table(spark, sf_dir, "orders"), {k: (w, D.reading_steps("DMY", 2024)) for k, w in words.items()}).select("o_orderkey", F.col("a.iso").alias("own"), F.col("a.inherited").alias("own_inherited"), F.col("b.iso").alias("taken"), "b.inherited")


@query("SELECT o_orderkey, true AS slashes, day(o_orderdate) <= 31 AS dots, true AS named, false AS order_no FROM orders")
def f3_date_like(spark, sf_dir):
    on = lambda p: D.date_like(F.date_format("o_orderdate", p))
    return table(spark, sf_dir, "orders").select("o_orderkey", on("MM/dd/yyyy").alias("slashes"), on("dd.MM").alias("dots"), on("d MMM").alias("named"), D.date_like(F.concat(F.lit("no. "), F.col("o_orderkey").cast("string"))).alias("order_no"))


@query("SELECT o_orderkey, concat(strftime(o_orderdate, '%d.%m.%Y'), '|Rent paid|', amount) AS parts, 42.0::DOUBLE AS x0, 42.0::DOUBLE + 5 * 11 AS x1_or_end FROM (SELECT *, concat('-', 100 + o_orderkey % 900, ',', lpad((o_orderkey % 100)::VARCHAR, 2, '0')) AS amount FROM orders)")
def e14_split_run(spark, sf_dir):
    k = F.col("o_orderkey")
    amount = F.concat(F.lit("-"), (100 + k % 900).cast("string"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"))
    run = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" Rent paid "), amount)
    runs = table(spark, sf_dir, "orders").select("o_orderkey", run.alias("str"), F.lit(42.0).alias("x"), (5.0 * F.length(run)).alias("w"))
    cells = C.split_runs(runs).select("o_orderkey", F.col("cells").alias("c"))
    # The middle starts where the date ends; its own first character comes a blank later.
    return cells.select("o_orderkey", F.array_join(F.transform("c", lambda c: c["str"]), "|").alias("parts"), F.round(F.col("c")[0]["x"], 6).alias("x0"), F.round(F.col("c")[1]["x"] + 5, 6).alias("x1_or_end"))


@query(f"WITH {P} SELECT doc_id, idx, true AS money, false AS words, false AS day FROM p")
def e15_money_shape(spark, sf_dir):
    rows = printed_rows(spark, sf_dir)
    return rows.select("doc_id", "idx", A.money_shape(F.col("amount_text")).alias("money"), A.money_shape(F.col("description")).alias("words"), A.money_shape(F.replace(F.col("date_text"), F.lit("/"), F.lit("-"))).alias("day"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(f"SELECT doc_id, n, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'), ' ') AS key FROM ({LINES})")
def e17_row_key(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.col("n").cast("long").alias("n"), X.row_key(F.col("line")).alias("key"))


@query("SELECT page_id, trim(regexp_replace(html, '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g'), ' ') AS text FROM pages")
def e18_squeeze(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.squeeze(F.col("html")).alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', '''') AS text FROM pages")
def e21_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.entities(F.col("html")).alias("text"))


@query("""SELECT doc_id, CASE WHEN contains(text, ';') OR regexp_matches(text, '["\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS semicolon, CASE WHEN contains(text, chr(9)) OR regexp_matches(text, '["\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS tab FROM documents""")
def e24_csv_field(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.csv_field(F.col("text"), ";").alias("semicolon"), M.csv_field(F.col("text"), "\t").alias("tab"))


_SIGN = "CASE WHEN amount_cents < 0 THEN '-' ELSE '' END"


@query(f"""WITH {L} SELECT doc_id, idx, concat({_SIGN}, abs(amount_cents) // 100, ',', lpad((abs(amount_cents) % 100)::VARCHAR, 2, '0')) AS plain_de, concat({_SIGN}, {grouped('amount_cents', '.', ',')}) AS shown_de, concat({_SIGN}, {indian('amount_cents')}) AS shown_in FROM l""")
def e25_locale_amounts(spark, sf_dir):
    a, de, hi = E.money(F.col("amount_cents")), M.market("de-DE"), M.market("hi-IN")
    return ledger(spark, sf_dir).select("doc_id", "idx", M.plain_amount(a, de.decimal).alias("plain_de"), M.display_amount(a, de.decimal, de.thousands, False).alias("shown_de"), M.display_amount(a, hi.decimal, hi.thousands, True).alias("shown_in"))


@query("WITH c AS (SELECT c_custkey, ['de-DE', 'fr-CA', 'xx-XX', 'hi-IN'][1 + c_custkey % 4] AS code FROM customer) SELECT c_custkey, code, CASE code WHEN 'de-DE' THEN ',' WHEN 'fr-CA' THEN ',' ELSE '.' END AS decimal, CASE code WHEN 'de-DE' THEN ';' WHEN 'fr-CA' THEN ';' ELSE ',' END AS delimiter, CASE code WHEN 'de-DE' THEN 'DD.MM.YYYY' WHEN 'fr-CA' THEN 'YYYY-MM-DD' WHEN 'hi-IN' THEN 'DD/MM/YYYY' ELSE 'MM/DD/YYYY' END AS date_format FROM c")
def j15_market_lookup(spark, sf_dir):
    code = F.get(F.array(*[F.lit(x) for x in ("de-DE", "fr-CA", "xx-XX", "hi-IN")]), (F.col("c_custkey") % 4).cast("int"))
    return M.with_market(table(spark, sf_dir, "customer").select("c_custkey", code.alias("code")), "code").select("c_custkey", "code", "decimal", "delimiter", "date_format")


@query("SELECT p_partkey, len(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains(regexp_split_to_array(lower(concat(p_name, ' ', p_brand)), '[^a-z0-9]+'), w))) = 0 AS covers, true AS own FROM part")
def e29_description_covers(spark, sf_dir):
    got = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", X.description_covers(F.col("p_type"), got).alias("covers"), X.description_covers(F.col("p_name"), got).alias("own"))


@query(f"""WITH {P}, c AS (SELECT doc_id, idx, 'date' AS kind FROM p UNION ALL SELECT doc_id, idx, 'text' FROM p UNION ALL SELECT doc_id, idx, CASE WHEN abs(amount_cents) < 3200 THEN 'odd' ELSE 'money' END FROM p UNION ALL SELECT doc_id, idx, CASE WHEN okey < 1000 THEN 'weak_number' ELSE 'money' END FROM p)
SELECT kind, count(*) AS n FROM c GROUP BY kind""")
def a25_cell_kinds(spark, sf_dir):
    rows = printed_rows(spark, sf_dir)
    cells = rows.select(F.explode(F.array("date_text", "description", "amount_text", F.col("okey").cast("string"))).alias("t"))
    return C.classified(cells, F.col("t"), "kind", "amount").groupBy("kind").agg(F.count("*").alias("n"))


HEADINGS = [("Running Balance", "balance"), ("Withdrawals:", "debit"), ("Paid in", "credit"), ("Amount *", "amount"), ("Value Date", "date"), ("Narration", "description"), ("zzz", None), ("Closing bal", "balance"), ("Money Out", "debit"), ("Dr.", "debit"), ("", None)]


@query(f"SELECT p_partkey, {_listed([t for _, t in HEADINGS])}[p_partkey % {len(HEADINGS)} + 1] AS task FROM part")
def f4_heading(spark, sf_dir):
    """labels as they are printed: in capitals or not, with blanks and marks."""
    k = F.col("p_partkey")
    label = dealt([x for x, _ in HEADINGS], k)
    shown = F.concat(dealt(["", " ", "  "], k), F.when(k % 2 == 0, F.upper(label)).otherwise(label), dealt(["", ":", " *", ".", " "], k))
    return table(spark, sf_dir, "part").select("p_partkey", C.heading(shown).alias("task"))


STOPS = [("Total for May", True), ("b/f", True), ("Page 3 of 4", True), ("Closing balance", True), ("Coffee", False), ("Subtotal", True), ("  Opening", True), ("A total", False), ("This statement", True), ("Balance forward", True), ("Openings & Co", False), ("Please note: fees", True), ("Deposits may not be", True)]


@query(f"WITH {PRICED} SELECT k, {_listed([t for _, t in STOPS])}[k % {len(STOPS)} + 1]::BOOLEAN AS stop FROM r")
def f6_no_row(spark, sf_dir):
    """rows of a label and a price."""
    text = F.concat(dealt([x for x, _ in STOPS], F.col("k")), F.lit(" "), F.col("written"))
    return prices(spark, sf_dir).select("k", C.no_row(text).alias("stop"))


VOTES = f"""{P}, v AS (SELECT doc_id, count(*) FILTER (doc_id % 2 = 1 AND day(txn_date) > 12) AS dmy, count(*) FILTER (doc_id % 2 = 0 AND day(txn_date) > 12) AS mdy FROM p GROUP BY doc_id)"""


def date_votes(rows, text: str):
    """Votes of numeric dates by document, with the order under either default."""
    dmy, mdy = D.votes(F.col("f"))
    votes = X.through(rows, {"f": (F.col(text), D.FIELD_STEPS)}).groupBy("doc_id").agg(F.count_if(dmy).alias("dmy"), F.count_if(mdy).alias("mdy"))
    order = lambda default: F.when(F.col("dmy") > F.col("mdy"), "DMY").when(F.col("mdy") > F.col("dmy"), "MDY").otherwise(default)
    return votes.select("doc_id", "dmy", "mdy", order("MDY").alias("order_v1"), order("DMY").alias("order_v2"), (F.col("dmy") == F.col("mdy")).alias("ambiguous"))


@query(f"WITH {VOTES} SELECT doc_id, dmy, mdy, CASE WHEN dmy > mdy THEN 'DMY' ELSE 'MDY' END AS order_v1, CASE WHEN mdy > dmy THEN 'MDY' ELSE 'DMY' END AS order_v2, dmy = mdy AS ambiguous FROM v")
def a9_date_order_vote(spark, sf_dir):
    return date_votes(printed_rows(spark, sf_dir), "date_text")


@query(f"""WITH {P}, y AS (SELECT doc_id, page, idx, year(txn_date)::INT AS y FROM p), m AS (SELECT doc_id, max(y) AS max_year FROM y WHERE page <= 2 AND y BETWEEN 2000 AND 2099 GROUP BY doc_id),
f AS (SELECT doc_id, arg_min(y, idx) AS first_year FROM y WHERE page <= 2 GROUP BY doc_id), c AS (SELECT doc_id, y, count(*) AS n, min(idx) AS first FROM y WHERE y BETWEEN 1900 AND 2099 GROUP BY ALL)
SELECT f.doc_id, coalesce(max_year, first_year) AS year_v1, (SELECT y FROM c WHERE c.doc_id = f.doc_id ORDER BY n DESC, first LIMIT 1) AS year_v2 FROM f LEFT JOIN m USING (doc_id)""")
def a11_statement_years(spark, sf_dir):
    """The largest 20xx of the first two pages, else the first date's year. A12: the most frequent year, of equal ones the first."""
    rows = printed_rows(spark, sf_dir)
    early = rows.where("page <= 2").groupBy("doc_id").agg(F.array_max(F.flatten(F.collect_list(F.regexp_extract_all("date_text", F.lit(r"\b(20\d{2})\b"), F.lit(1))))).cast("int").alias("largest"), F.min(F.struct("idx", D.parse_date(F.col("date_text"))["year"].alias("y")))["y"].alias("first"))
    each = rows.select("doc_id", "idx", F.explode(F.regexp_extract_all("date_text", F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))).alias("y")).withColumn("y", F.col("y").cast("int"))
    mode = each.groupBy("doc_id", "y").agg(F.count("*").alias("n"), F.min("idx").alias("first")).groupBy("doc_id").agg(F.max_by("y", F.struct("n", -F.col("first"))).alias("year_v2"))
    return early.join(mode, "doc_id").select("doc_id", F.coalesce("largest", "first").alias("year_v1"), "year_v2")


# --- exports

#: Ledger rows as an export sees them.
EXPORT = f"""{P}, x AS (SELECT *, strftime(txn_date, '%Y-%m-%d') AS iso, CASE WHEN amount_cents < 0 THEN -amount_cents END AS debit_cents, CASE WHEN amount_cents > 0 THEN amount_cents END AS credit_cents FROM p)"""


def export_rows(spark, sf_dir):
    a = F.col("amount_cents")
    rows = printed_rows(spark, sf_dir).withColumn("iso", F.col("txn_date").cast("string")).withColumn("debit_cents", F.when(a < 0, -a)).withColumn("credit_cents", F.when(a > 0, a))
    return rows.withColumn("flags", F.when(F.col("okey") % 97 == 0, F.array(F.lit("balance-mismatch"), F.lit("multiline-description"))).otherwise(F.array().cast("array<string>"))).withColumn("date_raw", F.col("date_text")).withColumn("raw_text", F.concat_ws(" ", "date_text", "description", "amount_text"))


def _plain(c: str, point: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' ELSE concat(CASE WHEN {c} < 0 THEN '-' ELSE '' END, abs({c}) // 100, '{point}', lpad((abs({c}) % 100)::VARCHAR, 2, '0')) END"


@query(f"""WITH {EXPORT} SELECT doc_id, idx, concat_ws('|', strftime(txn_date, '%d.%m.%Y'), description, {_plain('debit_cents', ',')}, {_plain('credit_cents', ',')}, {_plain('amount_cents', ',')}, {_plain('balance_cents', ',')}) AS csv_de,
  concat_ws('|', strftime(txn_date, '%m/%d/%Y'), description, {_plain('amount_cents', '.')}) AS quickbooks, concat_ws('|', strftime(txn_date, '%d/%m/%Y'), {_plain('amount_cents', '.')}, '', description, '') AS xero,
  concat_ws('|', strftime(txn_date, '%m/%d/%Y'), description, {_plain('debit_cents', '.')}, {_plain('credit_cents', '.')}, {_plain('amount_cents', '.')}, {_plain('balance_cents', '.')}, CASE WHEN okey % 97 = 0 THEN 'balance-mismatch; multiline-description' ELSE '' END) AS xlsx FROM x""")
def k2_preset_rows(spark, sf_dir):
    show = lambda *a: F.array_join(E.preset_row(*a), "|")
    return export_rows(spark, sf_dir).select("doc_id", "idx", show("csv", "de-DE").alias("csv_de"), show("quickbooks").alias("quickbooks"), show("xero", "en-GB").alias("xero"), show("xlsx").alias("xlsx"))


@query(f"""WITH {EXPORT}, r AS (SELECT doc_id, idx, concat_ws(';', strftime(txn_date, '%d.%m.%Y'), description, {_plain('debit_cents', ',')}, {_plain('credit_cents', ',')}, {_plain('amount_cents', ',')}, {_plain('balance_cents', ',')}) || chr(13) || chr(10) AS line FROM x)
SELECT doc_id, count(*) AS row_count, sha256(chr(65279) || 'Date;Description;Debit;Credit;Amount;Balance' || chr(13) || chr(10) || string_agg(line, '' ORDER BY idx)) AS sha256 FROM r GROUP BY doc_id""")
def k1_csv_files(spark, sf_dir):
    return E.csv_files(export_rows(spark, sf_dir), "csv", "de-DE").select("doc_id", "row_count", F.sha2("content", 256).alias("sha256"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN concat(replace(s_name, '#', ''), '-final-transactions.csv') WHEN 3 THEN concat(repeat('a', 60), '-transactions.csv') WHEN 4 THEN concat('x.y_z-', s_suppkey, '-transactions.csv') ELSE 'bank-statement-transactions.csv' END AS name FROM supplier""")
def k4_file_names(spark, sf_dir):
    """K4: names with marks, without any letter, too long, or none."""
    k = F.col("s_suppkey")
    source = F.when(k % 5 == 0, F.concat("s_name", F.lit(" (final).pdf"))).when(k % 5 == 2, "???.OFX").when(k % 5 == 3, F.concat(F.repeat(F.lit("a"), F.lit(80)), k.cast("string"), F.lit(".csv"))).when(k % 5 == 4, F.concat(F.lit("x.y_z-"), k.cast("string"), F.lit(".qfx")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", E.file_name(source, "csv").alias("name"))


@query(f"""WITH {EXPORT}, g AS (SELECT *, lag(balance_cents) OVER (PARTITION BY doc_id ORDER BY idx) + amount_cents - balance_cents AS off FROM x)
SELECT doc_id, idx, idx AS row_no, strftime(txn_date, '%Y-%m-%d') AS day, {_plain('off', '.')} AS delta, CASE WHEN okey % 97 = 0 THEN 'balance-mismatch' ELSE '' END AS notes FROM g""")
def k6_workbook_rows(spark, sf_dir):
    return E.workbook_rows(export_rows(spark, sf_dir)).select("doc_id", "idx", F.col("row_no").cast("long").alias("row_no"), F.col("day").cast("string").alias("day"), "delta", "notes")


# --- OFX

#: The ledger rendered as OFX, with closing tags where doc_id is even; the closing balance is 1,000.00.
def ofx_files(spark, sf_dir):
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.when(F.col("doc_id") % 2 == 0, F.lit(f"</{name}>")).otherwise(F.lit("\r\n")))
    text = lambda x: x.cast("string")
    rows = ledger(spark, sf_dir)
    one = F.concat(
        F.lit("<STMTTRN>"), tag("TRNTYPE", F.when(F.col("amount_cents") < 0, "DEBIT").otherwise("CREDIT")), tag("DTPOSTED", F.concat(F.date_format("txn_date", "yyyyMMdd"), F.lit("123000[-5:EST]"))), tag("TRNAMT", text(E.money(F.col("amount_cents")))),
        tag("FITID", text(F.col("okey"))), F.when(F.col("okey") % 3 > 0, tag("NAME", F.concat(F.lit("P &amp; Q "), text(F.col("okey"))))).otherwise(""), F.when(F.col("okey") % 3 == 1, tag("MEMO", F.lit("order"))).otherwise(""), F.when(F.col("doc_id") % 2 == 0, "</STMTTRN>").otherwise(""),
    )
    lists = rows.select("doc_id", "idx", one.alias("one")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "one"))), lambda x: x["one"]), "").alias("all"))
    head = F.concat(F.lit("OFXHEADER:100\r\n\r\n<OFX><BANKMSGSRSV1><STMTTRNRS><STMTRS>"), tag("CURDEF", F.lit("USD")), F.lit("<BANKACCTFROM>"), tag("BANKID", F.lit("121")), tag("ACCTID", text(F.col("doc_id"))), F.lit("</BANKACCTFROM><BANKTRANLIST>"), tag("DTSTART", F.lit("20240101")), tag("DTEND", F.lit("20241231")))
    return lists.select("doc_id", F.concat(head, F.col("all"), F.lit("</BANKTRANLIST><LEDGERBAL>"), tag("BALAMT", F.lit("1000.00")), F.lit("</LEDGERBAL></STMTRS></STMTTRNRS></BANKMSGSRSV1></OFX>")).alias("content"))


@query(f"""WITH {L} SELECT doc_id, idx - 1 AS idx, strftime(txn_date, '%Y-%m-%d') AS iso, '12:30' AS time, amount_cents, (100000 - sum(amount_cents) OVER (PARTITION BY doc_id) + sum(amount_cents) OVER (PARTITION BY doc_id ORDER BY idx))::BIGINT AS balance_cents,
  CASE okey % 3 WHEN 1 THEN concat('P & Q ', okey, ' · order') WHEN 2 THEN concat('P & Q ', okey) ELSE CASE WHEN amount_cents < 0 THEN 'Debit' ELSE 'Credit' END END AS description, okey::VARCHAR AS fit_id FROM l""")
def d17_ofx_transactions(spark, sf_dir):
    return O.transactions(ofx_files(spark, sf_dir)).select("doc_id", "idx", "iso", "time", "amount_cents", "balance_cents", "description", "fit_id")


@query(f"WITH {L} SELECT DISTINCT doc_id, 'USD' AS currency, concat('121 ', doc_id) AS account, '2024-01-01' AS start, '2024-12-31' AS \"end\", 'period 2024-01-01 to 2024-12-31' AS warnings FROM l")
def s9_ofx_statements(spark, sf_dir):
    return O.statements(ofx_files(spark, sf_dir)).select("doc_id", "currency", "account", "start", "end", F.array_join("warnings", "; ").alias("warnings"))


@query(f"WITH {L} SELECT DISTINCT doc_id, true AS ofx, false AS other FROM l")
def s1_ofx_sniff(spark, sf_dir):
    return ofx_files(spark, sf_dir).select("doc_id", O.looks_like_ofx(F.col("content").cast("binary")).alias("ofx"), O.looks_like_ofx(F.lit("%PDF-1.7").cast("binary")).alias("other"))


@query(f"WITH {L} SELECT doc_id, count(*) AS row_count, 'May-transactions.xlsx' AS file_name, true AS is_zip FROM l GROUP BY doc_id")
def k5_workbooks(spark, sf_dir):
    out = E.build_exports(export_rows(spark, sf_dir), "xlsx", source="May.pdf", locale="de-DE")
    return out.select("doc_id", "row_count", "file_name", (F.hex(F.substring("bytes", 1, 2)) == "504B").alias("is_zip"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 100 < 70 THEN 2000 ELSE 1900 END + c_custkey % 100 AS two_digits, 1900 + c_custkey % 300 AS four_digits FROM customer")
def e9_full_year(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", D.full_year(F.lpad((k % 100).cast("string"), 2, "0")).cast("long").alias("two_digits"), D.full_year((1900 + k % 300).cast("string")).cast("long").alias("four_digits"))


@query("SELECT o_orderkey, concat('A & ', o_orderpriority) AS name, NULL::VARCHAR AS memo, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_orderkey % 2 = 0 THEN '08:15' END AS time FROM orders")
def e20_ofx_tags(spark, sf_dir):
    """Tags with and without an end, entities, and dates with and without a time."""
    clock = F.when(F.col("o_orderkey") % 2 == 0, "081500.000[-5:EST]").otherwise("")
    block = F.concat(F.lit("<STMTTRN><dtposted>"), F.date_format("o_orderdate", "yyyyMMdd"), clock, F.lit("\r\n<NAME> A &amp; "), F.col("o_orderpriority"), F.lit(" </NAME><MEMO></MEMO>"))
    t = table(spark, sf_dir, "orders").select("o_orderkey", block.alias("b"))
    tag = lambda name: O.tag(O.pieces(F.col("b")), O.names(O.pieces(F.col("b"))), name)
    on = O.ofx_date(F.col("posted"))
    return t.select("o_orderkey", tag("NAME").alias("name"), tag("MEMO").alias("memo"), tag("DTPOSTED").alias("posted")).select("o_orderkey", "name", "memo", on["iso"].alias("iso"), on["time"].alias("time"))


@query(f"WITH {L}, g AS (SELECT *, lag(balance_cents) OVER (PARTITION BY doc_id ORDER BY idx) AS previous FROM l) SELECT doc_id, idx, abs(previous + amount_cents - balance_cents) / 100.0::DOUBLE <= 0.005 AS agrees, abs(previous + amount_cents - balance_cents) / 100.0::DOUBLE <= 100.0 AS near FROM g WHERE previous IS NOT NULL AND balance_cents IS NOT NULL")
def e7_balances_agree(spark, sf_dir):
    from ..operators.reconcile import balance_chain

    c = balance_chain(ledger(spark, sf_dir)).where("checked")
    units = lambda x: F.col(x) / 100
    return c.select("doc_id", "idx", A.agree(units("expected"), units("balance_cents")).alias("agrees"), A.agree(units("expected"), units("balance_cents"), 100.0 + 1e-9).alias("near"))
