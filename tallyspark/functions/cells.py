"""What a cell of a statement is: date, money, number, heading or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amounts import AMOUNT_STEPS, LONGEST, NO_AMOUNT, PLAIN, amount_like, money_shape, parse_amount, plain_amount
from .dates import FIELD_STEPS, MONTHS, SLASHED, any_date, date_steps, dated_steps, month_number, no_date, slashed_fields
from .text import SPACE, let, strip, through

#: Words of bank statements by what they speak of, in English, German, French, Spanish, Italian and Portuguese, without accents.
STATE = "balance bal saldo solde kontostand".split()
DEBIT = "debit debits dr withdrawal withdrawals charge charges soll lastschrift belastung cargo cargos dare addebito debito sortie sorties retrait retiros".split()
CREDIT = "credit credits cr deposit deposits haben gutschrift abono abonos avere accredito credito entree entrees versement ingresos".split()
AMOUNT = "amount amt betrag umsatz montant importe monto importo valor".split()
DATE = "date dt datum fecha data buchungstag valuta".split()
WORDING = "description desc detail details narration narrative particular particulars remark remarks memo payee merchant reference transaction transactions text verwendungszweck buchungstext libelle concepto detalle causale descrizione descricao historico".split()
FLOW, INTO, OUT_OF = "paid money payment payments funds".split(), "in received".split(), "out made".split()
STAGE = "opening starting beginning initial previous closing ending final new".split()
SUMS = "total totals subtotal subtotals summe somme totale".split()
ACCENTS = ("áàâäãéèêëíìîïóòôöõúùûüçñß", "aaaaaeeeeiiiiooooouuuucns")


def label_words(text: Column) -> Column:
    """The words of a label in lower case, without accents and marks."""
    return F.filter(F.split(F.translate(F.lower(text), *ACCENTS), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def heading(text: Column) -> Column:
    """the task of a column heading, or null. A state of the account decides before a side of it, a side before an amount, and that
    before dates and wording; money that goes in or out has a side without a word for it."""

    def task_of(words: Column) -> Column:
        has = lambda of: F.exists(words, lambda w: w.isin(of))
        moves = lambda where: (has(FLOW) & has(where)) | has([f + w for f in FLOW for w in where])
        return F.when(has(STATE), "balance").when(has(DEBIT) | moves(OUT_OF), "debit").when(has(CREDIT) | moves(INTO), "credit").when(has(AMOUNT), "amount").when(has(DATE), "date").when(has(WORDING), "description")

    return let(label_words(text), task_of)


def no_row(text: Column) -> Column:
    """whether a row's text says a state of the account, a sum, what is due, where a page ends, or small print, by its first two words."""

    def begins(words: Column) -> Column:
        first, second = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
        figure = second.rlike("^[0-9]*$")
        state = (first.isin(STAGE) & (second.isin(STATE) | figure)) | (first.isin(STATE) & second.isin("brought", "carried", "forward", "due", "b", "c")) | (first.isin("brought", "carried", "b", "c") & second.isin("forward", "fwd", "f", "d"))
        due = (first.isin("minimum", "amount", "payment", "past") & second.isin("due", "payment")) | (first.isin(SUMS)) | ((first == "sub") & second.isin(SUMS))
        edge = (first.isin("page", "seite", "pagina", "folio", "blatt") & figure & (second != "")) | first.isin("continued", "continues", "fortsetzung")
        print_ = first.isin("important", "notice", "disclaimer") | (first.isin("please", "kindly") & second.isin("note", "see", "contact", "refer", "read", "examine")) | ((first == "this") & second.isin("is", "statement", "page", "account", "document"))
        insured = (first.isin("deposit", "deposits", "funds") & second.isin("may", "are", "not")) | (first.isin("member", "members") & second.isin("fdic", "sipc", "finra")) | ((first == "equal") & second.isin("housing", "opportunity"))
        return state | due | edge | print_ | insured

    return let(label_words(text), begins)


def _kind(text: Column, amount: Column, dated: Column) -> Column:
    """A currency, a sign or grouping marks prove money; else dates come first."""
    proof = F.coalesce(amount["strong"] & (amount["currency"].isNotNull() | amount["negative"] | F.contains(text, F.lit(",")) | F.contains(text, F.lit("("))), F.lit(False))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", "text").when(~proof & dated, "date").when(amount_like(text, amount), "money").when(amount.isNotNull(), "weak_number").otherwise("text")


def examined(text: Column) -> Column:
    """struct(kind, cents): classify(text), and what it comes to as an amount."""
    return let(F.struct(text.alias("t"), parse_amount(text).alias("a")), lambda x: F.struct(_kind(x["t"], x["a"], any_date(x["t"])).alias("kind"), x["a"]["cents"].alias("cents")))


def classify(text: Column) -> Column:
    """date, money, weak_number or text."""
    return examined(text)["kind"]


def classified(df: DataFrame, text: Column, kind: str, amount: str) -> DataFrame:
    """df with columns `kind`, classify(text), and `amount`, parse_amount(text), by generated code."""
    own, date = f"_{kind}_text", f"_{kind}_date"
    read = through(df.withColumn(own, text), {amount: (F.col(own), AMOUNT_STEPS), date: (F.col(own), date_steps("DMY"))})
    return read.withColumn(kind, _kind(F.col(own), F.col(amount), F.col(date).isNotNull())).drop(own, date)


#: What parts of a run's text may turn out to be: the whole, its first one to three words as a date, its last word as an amount;
#: from REST on what is left between a date of k words and, if m is 1, an amount: REST + 2 * k + m.
WHOLE, LAST, REST = 0, 4, 10


def _slots(s: Column, p: Column, opens: Column, shaped: Column) -> Column:
    """struct(slot, str, text, at, to) of every part of a text that must be read; p: its words; opens: whether it may begin
    with a date; shaped: whether it ends like an amount. `text` is what is read, `str` what is shown."""
    n, size = F.size(p), F.length(s)
    slot = lambda k, shown, at, to, text=None: F.struct(F.lit(k).alias("slot"), shown.alias("str"), (shown if text is None else text).alias("text"), at.alias("at"), to.alias("to"))
    ends = {0: F.lit(0)} | {j: F.length(F.regexp_extract(s, rf"^{SPACE}*" + rf"{SPACE}+".join([rf"[^{SPACE[1:-1]}]+"] * j), 0)) for j in (1, 2, 3)}
    last = F.get(p, n - 1)
    begins = {0: size, 1: size - F.length(F.regexp_replace(s, f"^{SPACE}+", "")) + F.length(strip(s)) - F.length(last)}
    out = [slot(WHOLE, s, F.lit(0), size), F.when(shaped, slot(LAST, last, begins[1], size))]
    for j in (1, 2, 3):
        first = F.array_join(F.slice(p, F.lit(1), j), " ")
        out.append(F.when(opens & (n > j), slot(j, first, F.lit(0), ends[j], F.regexp_replace(first, "[,.]$", ""))))
    for k in range(4):
        for m in (0, 1):
            if k or m:
                between = strip(F.substring(s, ends[k] + 1, begins[m] - ends[k]))
                out.append(F.when((opens & (n > k) if k else F.lit(True)) & (shaped if m else F.lit(True)), slot(REST + 2 * k + m, between, ends[k], begins[m])))
    return F.array_compact(F.array(*out))


def _words(s: Column) -> Column:
    return F.filter(F.split(strip(s), f"{SPACE}+"), lambda z: z != "")


def _opens(p: Column) -> Column:
    """Whether a text of the words p may begin with a date: only what starts with a digit or a month is tried."""
    first = F.get(p, F.lit(0))
    return F.coalesce((F.size(p) > 1) & (F.substring(first, 1, 1).between("0", "9") | month_number(F.regexp_extract(first, r"^\p{L}+", 0)).isNotNull()), F.lit(False))


def _shaped(p: Column) -> Column:
    """Whether a text of the words p ends like an amount."""
    return F.when(F.size(p) >= 2, money_shape(F.get(p, F.size(p) - 1))).otherwise(False)


#: How a text starts that may open with a digit or a month's name.
START = rf"^{SPACE}*(?:[0-9{''.join(sorted({c for names in MONTHS.values() for n in names.split() for c in (n[0], n[0].upper())}))}]|[^\x00-\x7f])"


def may_split(s: Column) -> Column:
    """Whether a text may hold a date before or an amount behind other words; searches for a blank, for START and for two decimals spare most texts the split into words."""
    return F.coalesce(F.when(s.rlike(SPACE) & (s.rlike(START) | s.rlike("[.,][0-9]{2}")), let(_words(s), lambda p: _opens(p) | _shaped(p))), F.lit(False))


def read_parts(df: DataFrame, text: Column) -> DataFrame:
    """df with `amount` and `fields`, what AMOUNT_STEPS and FIELD_STEPS make of a text. Most texts are plain amounts, dates with slashes, or neither beyond doubt: they are told at once, and only the others take
    the steps, each of which is a pass over their rows."""
    t, row = F.col("_word"), F.monotonically_increasing_id() >= 0
    # Always true, and keeps Spark from copying what makes the word into each test of it.
    words = df.withColumn("_word", F.when(row, F.coalesce(text, F.lit(""))))
    plain, slashed = t.rlike(PLAIN) & t.contains(",") & (F.length(t) <= LONGEST), t.rlike(SLASHED)
    at_once = plain | slashed | (t.rlike(NO_AMOUNT) & no_date(t))
    slow = through(words.where(~at_once), {"amount": (text, AMOUNT_STEPS), "fields": (text, FIELD_STEPS)})
    return words.where(at_once).withColumns({"amount": F.when(plain, plain_amount(t)), "fields": F.when(slashed, slashed_fields(t))}).unionByName(slow).drop("_word")


def _read(df: DataFrame, text: str, shown: str) -> DataFrame:
    """df with `amount`, `fields`, `date` of the column text, and `task` of the column shown, by generated code."""
    e = read_parts(df, F.col(text))
    # A heading has letters.
    return through(e, {"date": (F.col("fields"), dated_steps("DMY"))}).withColumn("task", F.when(F.col(shown).rlike(r"\p{L}"), heading(F.col(shown))))


def _found(text: str) -> list[Column]:
    dated = F.col("date").isNotNull()
    return [_kind(F.col(text), F.col("amount"), dated).alias("kind"), F.col("amount.cents").alias("cents"), F.when(dated, F.col("fields")).alias("fields"), F.col("task").alias("task")]


def read_strings(strings: DataFrame) -> DataFrame:
    """(str, parts) for each distinct text of strings(str): struct(str, at, to, kind, cents, fields, task) of a leading date, the middle and a
    trailing amount, or of the whole if there is nothing to split off. All parts that may be needed are read side by side,
    by generated code; fields are a date's, for whatever order its document has."""
    s, p, n = F.col("str"), F.col("_p"), F.size("_p")
    d = strings.select("str").where("str is not null").distinct().withColumn("_p", _words(s))
    d = d.withColumn("_opens", _opens(p)).withColumn("_shaped", _shaped(p))
    e = d.select("str", n.alias("n"), F.inline(_slots(s, p, F.col("_opens"), F.col("_shaped")))).toDF("str", "n", "slot", "shown", "text", "at", "to")
    part = F.struct(F.col("shown").alias("str"), "at", "to", *_found("text"))
    dated = F.col("date").isNotNull()
    g = _read(e, "text", "shown").groupBy("str").agg(F.map_from_entries(F.collect_list(F.struct("slot", part.alias("part")))).alias("read"), F.max("n").alias("n"), F.coalesce(F.max(F.when(F.col("slot").between(1, 3) & dated, F.col("slot"))), F.lit(0)).alias("k"))
    read = lambda slot: F.try_element_at("read", slot)
    g = g.withColumn("m", (read(F.lit(LAST)).isNotNull() & ((F.col("k") == 0) | (F.col("n") > 2))).cast("int"))
    rest = read(REST + 2 * F.col("k") + F.col("m"))
    date = read(F.col("k")).withField("kind", F.lit("date")).withField("cents", F.lit(None).cast("long"))
    parts = F.array_compact(F.array(F.when(F.col("k") > 0, date), F.when(rest["str"] != "", rest), F.when(F.col("m") == 1, read(F.lit(LAST)))))
    return g.select("str", F.when((F.col("k") == 0) & (F.col("m") == 0), F.array(read(F.lit(WHOLE)))).otherwise(parts).alias("parts"))


def split_runs(runs: DataFrame) -> DataFrame:
    """runs(str, x, w) with `cells`, an array of struct(str, x, w, kind, cents, fields, task). Most texts have nothing to split off and are read where they
    stand; the others are read once for each distinct text by read_strings(), and meet their runs by value, placed by even advance. A null text is one cell."""
    x, w, size = F.col("x").cast("double"), F.col("w").cast("double"), F.length("str")
    step = w / F.greatest(size, F.lit(1))

    def placed(c: Column) -> Column:
        whole = (c["at"] == 0) & (c["to"] == size)
        return F.struct(c["str"].alias("str"), F.when(whole, x).otherwise(x + c["at"] * step).alias("x"), F.when(whole, w).otherwise((c["to"] - c["at"]) * step).alias("w"), *[c[k].alias(k) for k in ("kind", "cents", "fields", "task")])

    whole = _read(runs.where(~may_split(F.col("str"))), "str", "str").select(*runs.columns, F.array(F.struct("str", x.alias("x"), w.alias("w"), *_found("str"))).alias("cells"))
    more = runs.where(may_split(F.col("str")))
    return whole.unionByName(more.join(read_strings(more), "str").withColumn("cells", F.transform("parts", placed)).select(*runs.columns, "cells"))
