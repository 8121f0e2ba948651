"""Text as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space in the wide sense: ASCII, no-break, narrow no-break and the other Unicode spaces.
WHITE = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chained(value: Column, steps) -> Column:
    """The steps, functions of a column, one after the other, as one expression for any place. Spark interprets it; through()
    gives the same by generated code."""
    first, *rest = steps
    out = first(value)
    return let(out, lambda x: chained(x, rest)) if rest else out


def through(df: DataFrame, jobs: dict[str, tuple]) -> DataFrame:
    """df with columns {name: (column, steps)}: as chained(), but each step is a projection of its own, so Spark generates
    code for it and computes what a later step uses several times once; the k-th steps of all jobs share one. HotSpot never compiles
    methods of more than 8,000 bytes, so Spark is told not to fuse projections beyond that. Filters on a result would be pushed
    down through all steps and copied at each, and Spark would merge steps whose results are structs, with what they share computed over and over; a row number that is always true stops both."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000:
        conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    own, always = {name: f"_{name}_step" for name in jobs}, F.monotonically_increasing_id() >= 0
    out, carried = df, list(df.columns)
    for k in range(max(len(steps) for _, steps in jobs.values())):
        read = lambda name, value, steps: steps[k](F.col(own[name]) if k else value) if k < len(steps) else F.col(own[name])  # noqa: B023, E731
        out = out.select(*carried, *[F.when(always, read(name, value, steps)).alias(own[name]) for name, (value, steps) in jobs.items()])
        carried = [c for c in carried if c not in jobs]
    return out.select(*carried, *[F.col(own[name]).alias(name) for name in jobs])


def read_once(df: DataFrame, column: str, jobs: dict[str, list]) -> DataFrame:
    """df with columns {name: steps} of the texts in `column`, as through() has them, but each distinct text is read once and meets its
    rows again by value. Spark broadcasts what was read if it turns out to be small; else both sides are dealt out by text."""
    texts = through(df.select(column).distinct(), {name: (F.col(column), steps) for name, steps in jobs.items()})
    return df.join(texts, column, "left").select(*df.columns, *jobs)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def row_key(text: Column) -> Column:
    """Lower case, digit runs as #, everything else but a-z as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), r"[^a-z#]+", " "))


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def description_covers(expected: Column, got: Column) -> Column:
    """Whether every word expected is among those parsed."""
    return F.size(F.array_except(plain_words(expected), plain_words(got))) == 0


def entities(text: Column) -> Column:
    """Entities decoded, the ampersand first."""
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        text = F.regexp_replace(text, f"(?i){name}", char)
    return text
