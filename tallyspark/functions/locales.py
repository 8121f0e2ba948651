"""How amounts, fields and dates are written for a market."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import let


@dataclass(frozen=True)
class Market:
    code: str
    decimal: str
    thousands: str
    grouping: str
    delimiter: str
    date_format: str

    @property
    def language(self) -> str:
        return self.code[:2]


#: Code, decimal point, thousands mark, grouping, CSV delimiter, date format.
MARKETS = tuple(
    Market(*row)
    for row in (
        ("en-US", ".", ",", "western", ",", "MM/DD/YYYY"),
        ("en-GB", ".", ",", "western", ",", "DD/MM/YYYY"),
        ("en-AU", ".", ",", "western", ",", "DD/MM/YYYY"),
        ("en-CA", ".", ",", "western", ",", "YYYY-MM-DD"),
        ("en-IN", ".", ",", "indian", ",", "DD/MM/YYYY"),
        ("es-ES", ",", ".", "western", ";", "DD/MM/YYYY"),
        ("es-MX", ".", ",", "western", ",", "DD/MM/YYYY"),
        ("es-AR", ",", ".", "western", ";", "DD/MM/YYYY"),
        ("es-CO", ",", ".", "western", ";", "DD/MM/YYYY"),
        ("de-DE", ",", ".", "western", ";", "DD.MM.YYYY"),
        ("de-AT", ",", ".", "western", ";", "DD.MM.YYYY"),
        ("de-CH", ".", "’", "western", ";", "DD.MM.YYYY"),
        ("fr-FR", ",", " ", "western", ";", "DD/MM/YYYY"),
        ("fr-CA", ",", " ", "western", ";", "YYYY-MM-DD"),
        ("pt-BR", ",", ".", "western", ";", "DD/MM/YYYY"),
        ("pt-PT", ",", " ", "western", ";", "DD/MM/YYYY"),
        ("hi-IN", ".", ",", "indian", ",", "DD/MM/YYYY"),
    )
)
DEFAULT = "en-US"


def market(code: str | None) -> Market:
    """A market by code, the default one for unknown codes."""
    known = {m.code: m for m in MARKETS}
    return known.get(code or "", known[DEFAULT])


def markets_of(language: str) -> list[Market]:
    return [m for m in MARKETS if m.language == language]


def markets_table(spark: SparkSession) -> DataFrame:
    """The markets as a dimension table of 17 rows."""
    rows = [(i, m.code, m.language, m.decimal, m.thousands, m.grouping, m.delimiter, m.date_format) for i, m in enumerate(MARKETS)]
    return spark.createDataFrame(rows, "ord int, code string, language string, decimal string, thousands string, grouping string, delimiter string, date_format string")


def with_market(df: DataFrame, code: str) -> DataFrame:
    """J15 over a column of codes: df with the market's columns, those of the default market for unknown codes."""
    m = F.broadcast(markets_table(df.sparkSession).drop("ord"))
    default = market(DEFAULT)
    out = df.join(m.withColumnRenamed("code", "_code"), F.col(code) == F.col("_code"), "left").drop("_code")
    for name, value in (("language", default.language), ("decimal", default.decimal), ("thousands", default.thousands), ("grouping", default.grouping), ("delimiter", default.delimiter), ("date_format", default.date_format)):
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def grouped_digits(digits: Column, thousands: Column, indian: Column) -> Column:
    """Marks between groups of three digits; Indian: the last three, then pairs."""
    by = lambda d, n: F.regexp_replace(d, rf"\B(?=(?:\d{{{n}}})+(?!\d))", "\x01")
    short = F.length(digits) <= 3
    lakh = F.concat(by(F.substring(digits, F.lit(1), F.length(digits) - 3), 2), F.lit("\x01"), F.right(digits, F.lit(3)))
    return F.replace(F.when(indian, F.when(short, digits).otherwise(lakh)).otherwise(by(digits, 3)), F.lit("\x01"), thousands)


def amount_text(value: Column, decimal: Column | str, thousands: Column | str = "", indian: Column | bool = False, group: bool = False, blank_zero: bool = False, places: int = 2) -> Column:
    """An amount (decimal or whole cents as decimal) with fixed places; '' for null and, with blank_zero, for 0."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)

    def build(v: Column) -> Column:
        text = F.abs(v).cast("string")
        whole, part = F.substring_index(text, ".", 1), F.when(F.lit(places > 0), F.concat(as_column(decimal), F.substring_index(text, ".", -1))).otherwise("")
        shown = grouped_digits(whole, as_column(thousands), as_column(indian)) if group else whole
        out = F.concat(F.when(v < 0, "-").otherwise(""), shown, part)
        return F.when(v.isNull() | ((v == 0) & F.lit(blank_zero)), "").otherwise(out)

    return let(value.cast(f"decimal(38,{places})"), build)


def plain_amount(value: Column, decimal: Column | str) -> Column:
    """For export, never grouped."""
    return amount_text(value, decimal)


def display_amount(value: Column, decimal: Column | str, thousands: Column | str, indian: Column | bool) -> Column:
    """For people, grouped and blank for zero."""
    return amount_text(value, decimal, thousands, indian, group=True, blank_zero=True)


def csv_field(text: Column, delimiter: Column | str) -> Column:
    """Quoted if it holds the delimiter in use, a quote or a line break."""
    d = delimiter if isinstance(delimiter, Column) else F.lit(delimiter)
    text = F.coalesce(text, F.lit(""))
    needs = F.contains(text, d) | text.rlike('["\r\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def guarded(text: Column) -> Column:
    """An opt-in guard for fields that a spreadsheet would take as formulas."""
    return F.when(text.rlike(r"^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


