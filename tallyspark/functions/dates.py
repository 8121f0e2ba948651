"""Dates as expressions, also partial ones without a year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, chained, let, strip

#: Month names and their short forms in English, German, French, Spanish, Portuguese, Italian and Dutch,
#: without accents, by month.
MONTHS = {
    1: "jan january januar jaen janner janv janvier ene enero janeiro gen gennaio januari",
    2: "feb february februar fevr fevrier febrero fev fevereiro febbraio februari",
    3: "mar march marz maer maerz mrz mars marzo marco mrt maart",
    4: "apr april avr avril abr abril aprile",
    5: "may mai mayo maio mag maggio mei",
    6: "jun june juni juin junio junho giu giugno",
    7: "jul july juli juil juillet julio julho lug luglio",
    8: "aug august aout ago agosto augustus",
    9: "sep sept september septembre septiembre set setembro settembre",
    10: "oct october okt oktober octobre octubre out outubro ott ottobre",
    11: "nov november novembre noviembre",
    12: "dec december dez dezember decembre dic diciembre dezembro dicembre",
}
SHORT = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
FORMATS = ("YYYY-MM-DD", "DD/MM/YYYY", "MM/DD/YYYY", "DD.MM.YYYY", "DD-MMM-YYYY")

ACCENTS = ("áàâäãåāçéèêëēíìîïñóòôöõōúùûüýÿ", "aaaaaaaceeeeeiiiinoooooouuuuyy")


def month_number(name: Column) -> Column:
    """E11."""
    table = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in names.split() for x in (n, m)])
    return F.try_element_at(table, F.regexp_replace(F.translate(F.lower(name), *ACCENTS), r"\.$", ""))


def full_year(text: Column) -> Column:
    """Two digits below 70 belong to this century, others to the last; null if empty."""
    n = text.try_cast("int")
    return F.when(F.length(text) <= 2, F.when(n < 70, 2000 + n).otherwise(1900 + n)).otherwise(n)


MARKS = ("-", "/", ".")
#: How the parts of a date stand together, # for each run of letters or digits: three numbers; two, or three with the same mark twice.
YEAR_FIRST = [f"#{x}#{y}#" for x in MARKS for y in MARKS]
NUMBERS = [f"#{x}#" for x in MARKS] + [f"#{x}#{x}#" for x in MARKS]


def _tidied(s: Column) -> Column:
    """A text with a digit, one closing mark left off and blanks squeezed; null without one, as no date does without."""
    return F.when(s.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(s, r"[./-]$", ""), f"{SPACE}+", " "))


def _framed(s: Column) -> Column:
    """struct(s, frame): with # for each run of letters or digits; null for texts too short or too long for a date, with two words, or without a word and with other marks
    between numbers than a date's: most texts are told from dates here."""
    may = s.rlike(r"^[0-9]+[-/.][0-9]+(?:[-/.][0-9]+)?$") | (s.rlike(r"\p{L}") & ~s.rlike(r"\p{L}[^\p{L}]+\p{L}"))
    return F.when(F.length(s).between(3, 24) & may, F.struct(s.alias("s"), F.regexp_replace(s, r"[\p{L}0-9]+", "#").alias("frame")))


def _parts(x: Column) -> Column:
    """struct(frame, numbers, names, led): the frame of a text that may be a date, its numbers and its words; whether a word comes
    first. Null for texts that no date looks like."""
    s, frame = x["s"], x["frame"]
    fields = F.struct(frame.alias("frame"), F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)).alias("numbers"), F.regexp_extract_all(s, F.lit(r"\p{L}+"), F.lit(0)).alias("names"), (~F.substring(s, 1, 1).between("0", "9")).alias("led"))
    return F.when(frame.startswith("#") & (F.length(frame) < F.length(s)), fields)


#: Each step uses the one before several times, and an interpreted expression is computed as often as it is used.
PART_STEPS = [strip, _tidied, _framed, _parts]


def _named(p: Column) -> Column:
    """struct(frame, led, count, month, first, second, third): first and later numbers as texts, month by name (0 without a name, null for another word)."""
    name = F.get(p["names"], F.lit(0))
    month = F.when(F.size(p["names"]) == 0, 0).when((F.size(p["names"]) == 1) & F.length(name).between(3, 9), month_number(name))
    numbers = [F.get(p["numbers"], F.lit(k)).alias(n) for k, n in enumerate(("first", "second", "third"))]
    return F.when(month.isNotNull(), F.struct(p["frame"].alias("frame"), p["led"].alias("led"), F.size(p["numbers"]).alias("count"), month.alias("month"), *numbers))


def _shaped(p: Column) -> Column:
    """p with its shape, which stands for the fields a, b, month and year: `year first` (a: month, b: day), `numbers` (a and b as they stand), `name first` or `name second` (a: day); null for others. What may stand between the parts:

    * year first: numbers of four and up to two digits, a mark of - / . each;
    * numbers: two of up to two digits and a mark of - / .; or the same mark again and two to four digits;
    * name second: a day, one or two of blank . -, a month's name; then any of blank . , - and, if it is there, a year;
    * name first: a month's name, perhaps a point, one or two of blank . -, a day; then a comma or a blank, if any, and a year.
    """
    frame, count, one, two, three = p["frame"], p["count"], F.length(p["first"]), F.length(p["second"]), F.length(p["third"])
    glued = (count == 1) & one.between(3, 6)  # day and year without anything between them
    cut = F.when(one == 3, 1).otherwise(2)
    shape = (
        F.when(p["month"] == 0, F.when((count == 3) & (one == 4) & (two <= 2) & (three <= 2) & frame.isin(YEAR_FIRST), "year first").when((one <= 2) & (two <= 2) & ((count == 2) | ((count == 3) & three.between(2, 4))) & frame.isin(NUMBERS), "numbers"))
        .when(p["led"], F.when(((one <= 2) | glued) & ((count == 1) | ((count == 2) & two.between(2, 4))) & frame.rlike("^#[.]?[ .-]{1,2}#(,? ?#?)$"), "name first"))
        .when((one <= 2) & ((count == 1) | ((count == 2) & two.between(2, 4))) & frame.rlike("^#[ .-]{1,2}#[ .,-]*#?$"), "name second")
    )
    return F.when(shape.isNotNull(), F.struct(shape.alias("shape"), (p["led"] & glued).alias("split"), cut.alias("cut"), *[p[c].alias(c) for c in ("month", "first", "second", "third")]))


def _dealt(p: Column) -> Column:
    """struct(shape, a, b, month, year) as texts."""
    shape, split, cut = p["shape"], p["split"], p["cut"]
    a = F.when(shape == "year first", p["second"]).when(split, F.substring(p["first"], F.lit(1), cut)).otherwise(p["first"])
    year = F.when(shape == "year first", p["first"]).when(shape == "numbers", p["third"]).when(split, F.substring(p["first"], cut + 1, F.lit(9))).otherwise(p["second"])
    return F.struct(shape.alias("shape"), a.alias("a"), F.when(shape == "year first", p["third"]).otherwise(p["second"]).alias("b"), p["month"].alias("month"), year.alias("year"))


def _numbered(f: Column) -> Column:
    """The same with a, b and month as numbers; null without a shape."""
    return F.when(f["shape"].isNotNull(), F.struct(f["shape"].alias("shape"), f["a"].try_cast("int").alias("a"), f["b"].try_cast("int").alias("b"), f["month"].alias("month"), f["year"].alias("year")))


FIELD_STEPS = [*PART_STEPS, _named, _shaped, _dealt, _numbered]


#: Dates that are told at once, and what most texts hold that are none: two words, or no digit. A month's name has three letters.
SLASHED, NO_DATE = "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$", r"\p{L}[^\p{L}]+\p{L}|^[^0-9]*$"


def slashed_fields(text: Column) -> Column:
    """What FIELD_STEPS make of a text of the form SLASHED."""
    part = lambda k: F.split_part(text, F.lit("/"), F.lit(k))
    return F.struct(F.lit("numbers").alias("shape"), part(1).try_cast("int").alias("a"), part(2).try_cast("int").alias("b"), F.lit(0).alias("month"), part(3).alias("year"))


def no_date(text: Column) -> Column:
    """Whether a text is beyond doubt no date."""
    return text.rlike(NO_DATE) | (text.rlike(r"\p{L}") & ~text.rlike(r"\p{L}{3}"))


def _placed(f: Column, order: Column, fallback: Column) -> Column:
    """struct(year, month, day, order): numbers in the stated order, turned if only that makes a month of one of them."""
    first, numbers = f["shape"] == "year first", f["shape"] == "numbers"
    turned = F.when(order == "DMY", (f["b"] > 12) & (f["a"] <= 12)).otherwise((f["a"] > 12) & (f["b"] <= 12))
    month_first = numbers & ((order != "DMY") != turned)
    month = F.when(first | month_first, f["a"]).when(numbers, f["b"]).otherwise(f["month"])
    day = F.when(first | month_first, f["b"]).otherwise(f["a"])
    said = F.when(first, "YMD").when(month_first | (f["shape"] == "name first"), "MDY").otherwise("DMY")
    year = F.when(first, f["year"].try_cast("int")).otherwise(F.coalesce(full_year(f["year"]), fallback))
    return F.when(f.isNotNull(), F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.alias("day"), said.alias("order")))


def _checked(d: Column) -> Column:
    """struct(year, month, day, order, iso) of real dates, null for others; a day up to 31 will do where the year is unknown."""
    y, m, day = d["year"], d["month"], d["day"]
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28).otherwise(31)
    real = m.between(1, 12) & day.between(1, 31) & F.when(y.isNull(), True).otherwise(y.between(1900, 2200) & (day <= longest))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    iso = F.concat_ws("-", F.coalesce(y.cast("string"), F.lit("-")), two(m), two(day))
    return F.when(real, F.struct(y.alias("year"), m.alias("month"), day.alias("day"), d["order"].alias("order"), iso.alias("iso")))


def date_steps(order: Column | str = "MDY", fallback_year: Column | int | None = None) -> list:
    """E8 in steps for chained() and through(): from a text to struct(year, month, day, order, iso), or null if it isn't one date."""
    order = F.lit(order) if isinstance(order, str) else order
    fallback = fallback_year if isinstance(fallback_year, Column) else F.lit(fallback_year).cast("int")
    return [*FIELD_STEPS, lambda f: _placed(f, order, fallback), _checked]


def dated_steps(order: Column | str = "MDY", fallback_year: Column | int | None = None) -> list:
    """The last of date_steps(): from what FIELD_STEPS make of a text."""
    return date_steps(order, fallback_year)[len(FIELD_STEPS) :]


def parse_date(text: Column, order: Column | str = "MDY", fallback_year: Column | int | None = None) -> Column:
    """struct(year, month, day, order, iso) of a text that is one date, else null."""
    return chained(text, date_steps(order, fallback_year))


def short_of_year(text: Column) -> Column:
    """Whether a text is two numbers around a point, such as 12.05: a day and a month, or an amount; what stands beside it decides."""
    return F.coalesce(text.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}$"), F.lit(False))


def any_date(text: Column) -> Column:
    """Whether a text is a date under either order. Orders that don't fit are turned, so one holds exactly if the other does."""
    return parse_date(text, "DMY").isNotNull()


def reading_steps(order: Column | str = "DMY", year: Column | int | None = None) -> list:
    """E19 in steps: the date of a word without a closing comma or semicolon, with `inherited` for a year that it took over."""
    word = lambda text: F.regexp_replace(strip(text), "[,;]$", "")
    *fields, placed, checked = date_steps(order, year)
    both = lambda f: F.struct(placed(f).alias("d"), f["year"].isNull().alias("bare"))
    known = lambda x: F.struct(checked(x["d"]).alias("d"), x["bare"].alias("bare"))
    named = lambda x: F.when(x["d"].isNotNull(), F.struct(*[x["d"][c].alias(c) for c in ("iso", "year", "month", "day")], (x["bare"] & x["d"]["year"].isNotNull()).alias("inherited")))
    return [word, *fields, both, known, named]


def date_reading(text: Column, order: Column | str = "DMY", year: Column | int | None = None) -> Column:
    """E19."""
    return chained(text, reading_steps(order, year))


def votes(f: Column) -> tuple[Column, Column]:
    """Of FIELD_STEPS' result, whether it votes for the day or for the month first; only numbers vote, as only one of them can be a month."""
    numbers = f["shape"] == "numbers"
    return numbers & (f["a"] > 12) & (f["b"] <= 12), numbers & (f["b"] > 12) & (f["a"] <= 12)


def date_like(text: Column) -> Column:
    """a cheap test of a text's shape: any word may be a month's name, and numbers go up to 31; calendars aside."""
    known = lambda p: F.struct(p["frame"].alias("frame"), p["led"].alias("led"), F.size(p["numbers"]).alias("count"), F.size(p["names"]).alias("month"), *[F.get(p["numbers"], F.lit(k)).alias(n) for k, n in enumerate(("first", "second", "third"))])
    fits = lambda p: (F.size(p["names"]) == 0) | ((F.size(p["names"]) == 1) & F.length(F.get(p["names"], F.lit(0))).between(3, 9))
    numbers = lambda f: (f["shape"] != "numbers") | (f["a"].between(1, 31) & f["b"].between(1, 31))
    return F.coalesce(chained(text, [*PART_STEPS, lambda p: F.when(fits(p), known(p)), _shaped, _dealt, _numbered, numbers]), F.lit(False))


def _resolved(iso: Column, year: Column | int) -> Column:
    year = year if isinstance(year, Column) else F.lit(year)
    return F.when(iso.rlike(r"^--\d{2}-\d{2}$"), F.concat(year.cast("string"), F.substring(iso, 2, 6))).otherwise(iso)


def format_date(iso: Column, form: Column | str, year: Column | int = 2000) -> Column:
    """An ISO or partial date in one of FORMATS; '' for null, unreadable texts as they are."""
    form = F.lit(form) if isinstance(form, str) else form

    def written(r: Column) -> Column:
        y, m, d = F.substring(r, 1, 4), F.substring(r, 6, 2), F.substring(r, 9, 2)
        name = F.coalesce(F.get(F.array(*[F.lit(x) for x in SHORT]), m.cast("int") - 1), m)
        return (
            F.when(form == "DD/MM/YYYY", F.concat_ws("/", d, m, y)).when(form == "MM/DD/YYYY", F.concat_ws("/", m, d, y)).when(form == "DD.MM.YYYY", F.concat_ws(".", d, m, y))
            .when(form == "DD-MMM-YYYY", F.concat_ws("-", d, name, y)).otherwise(F.concat_ws("-", y, m, d))
        )

    return let(F.coalesce(_resolved(iso, year), F.lit("")), lambda r: F.when(r == "", "").when(r.rlike(r"^\d{4}-\d{2}-\d{2}$"), written(r)).otherwise(F.coalesce(iso, F.lit(""))))


def to_date(iso: Column, year: Column | int = 2000) -> Column:
    """A date, partial ones in the given year; null for others."""
    return F.try_to_date(_resolved(iso, year), "yyyy-MM-dd")
