"""Rule-based quality with host-level verdicts, in DataFrame functions only.

Each document gets counts over its whole text and rule failures; the rules' failures are then summed by host, each
host's failure rate is shrunk towards the corpus rate with a beta prior fitted by moments to the hosts' rates, and a
host whose shrunk rate is too high loses all its documents. A document is kept if it passes the base rules and its
host's verdict.

Defined cases: a null text counts as empty and fails the base rules (under 50 words); a null host is a host of its own;
a corpus without documents gives none; repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, fresh, joined, quoted, scratch, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _repeated(w: Column) -> Column:
    """(text of a three-word window, its place) for every window, sorted, so equal windows stand together."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.struct(F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("k"), i.alias("i")))
    return F.sort_array(F.when(F.size(w) >= 3, windows).otherwise(F.array().cast("array<struct<k:string,i:int>>")))


def _covered(s: Column) -> Column:
    """Words in the windows of s that equal a neighbour, each word once."""
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    # Each place adds the words that the place before it doesn't reach.
    gaps = F.zip_with(places, F.concat(F.array(F.lit(-9)), places), lambda p, q: F.when(p.isNotNull(), F.least(p - q, F.lit(3))).otherwise(0))
    return F.aggregate(gaps, F.lit(0), lambda t, x: t + x)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words in a struct column `counts`, whose name
    is the last of the result's columns."""
    t, w, s, counts = fresh(docs, "text", "words", "windows", "counts")
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(t, F.coalesce(F.col(quoted(text_col)), F.lit(""))).withColumn(w, words(F.col(t)))
    out = out.withColumn(s, _repeated(F.col(w)))
    return out.withColumn(counts, F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col(s)).cast("long").alias("n_repeat_words"),
    )).drop(t, w, s)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = 0.6, prior_weight: float = 20.0) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rules_failed, host_rate).

    Rules beside the two base ones: words of 3 to 12 characters on average, at most one symbol for ten words, at most 30
    repeated lines for 100 words. A document fails if it breaks any; hosts are judged by the share that fails.
    prior_weight: the least number of pseudo-documents in the beta prior, so that a host of few documents is judged
    mostly by the corpus rate.
    """
    with scratch(docs.sparkSession) as s:
        narrow = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(host_col)).cast("string").alias("host"))
        m = measured(narrow).select("doc_id", "host", "_counts.*")
        n = F.col("n_words")
        base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
        rules = F.array(n < 50, 100 * F.col("n_repeat_words") > 50 * n, F.col("word_chars") < 3 * n, F.col("word_chars") > 12 * n, 10 * F.col("n_symbols") > n, 100 * F.col("n_dup_lines") > 30 * n)
        m = m.withColumn("base_failed", base).withColumn("rules_failed", F.size(F.filter(rules, lambda x: x)))
        m = s.save(m.withColumn("host", F.struct(F.col("host").isNull().alias("none"), F.coalesce("host", F.lit("")).alias("name"))))

        hosts = s.save(m.groupBy("host").agg(F.count("*").alias("docs"), F.sum((F.col("rules_failed") > 0).cast("long")).alias("failed")))
        # The prior's mean is the corpus rate; its weight follows from how much the rates of hosts vary beyond chance.
        rate = hosts.agg(F.sum("failed").alias("f"), F.sum("docs").alias("d"), F.sum(F.col("failed") * F.col("failed") / F.col("docs")).alias("sq"), F.count("*").alias("hosts"))
        p = F.coalesce(F.col("f") / F.greatest("d", F.lit(1)), F.lit(0.0))
        between = (F.col("sq") - F.col("d") * p * p - F.greatest(F.col("hosts") - 1, F.lit(0)) * p * (1 - p)) / F.greatest("d", F.lit(1))
        weight = F.greatest(F.lit(prior_weight), F.when(between > 0, F.least(p * (1 - p) / between - 1, F.lit(1e6))).otherwise(1e6))
        alpha, total = rate.select(p * weight, weight).first()  # two numbers
        judged = s.save(hosts.select("host", F.round((F.col("failed") + F.lit(alpha)) / (F.col("docs") + F.lit(total)), 9).alias("host_rate")))  # sums of doubles depend on their order beyond that
        out = joined(m, judged, ["host"], "left")
        return s.keep(out.select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).alias("kept"), "rules_failed", "host_rate",
        ))
