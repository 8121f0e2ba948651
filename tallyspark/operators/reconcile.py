"""The balance rule: previous balance + amount = balance, in whole cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(keys: list[str], order: str = "idx"):
    return Window.partitionBy(*keys).orderBy(order)


def balance_chain(rows: DataFrame, keys: list[str] = ["doc_id"], order: str = "idx") -> DataFrame:  # noqa: B006
    """Rows with previous, expected, checked, agrees, balance_change and balance_error. The first row and rows
    without both balances are not checked."""
    previous = F.lag("balance_cents").over(in_order(keys, order))
    out = rows.withColumn("previous", previous).withColumn("expected", F.col("previous") + F.col("amount_cents"))
    out = out.withColumn("checked", F.col("previous").isNotNull() & F.col("balance_cents").isNotNull())
    return (
        out.withColumn("agrees", F.when(F.col("checked"), F.col("expected") == F.col("balance_cents")))
        .withColumn("balance_change", F.col("balance_cents") - F.col("previous")).withColumn("balance_error", F.col("expected") - F.col("balance_cents"))
    )


def correct_signs(rows: DataFrame, keys: list[str] = ["doc_id"], order: str = "idx") -> DataFrame:  # noqa: B006
    """Amounts whose opposite fits the balances are turned; `sign_corrected` marks them."""
    turned = (F.col("amount_cents") != 0) & ~F.col("agrees") & (F.col("previous") - F.col("amount_cents") == F.col("balance_cents"))
    out = balance_chain(rows, keys, order).withColumn("sign_corrected", F.coalesce(turned, F.lit(False)))
    out = out.withColumn("amount_cents", F.when(F.col("sign_corrected"), -F.col("amount_cents")).otherwise(F.col("amount_cents")))
    return out.select(*rows.columns, "sign_corrected")


def summary(rows: DataFrame, keys: list[str] = ["doc_id"], order: str = "idx", more: tuple[Column, ...] = ()) -> DataFrame:  # noqa: B006
    """Checked, matched, pass_rate (0 if none is checked) and the mismatches of each chain. more: other aggregates of the same pass."""
    wrong = F.col("checked") & ~F.col("agrees")
    out = balance_chain(rows, keys, order).groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if("checked").alias("checked"), F.count_if(F.col("agrees")).alias("matched"),
        F.sort_array(F.collect_list(F.when(wrong, F.struct(F.col(order).alias("idx"), "previous", "expected", F.col("balance_cents").alias("actual"), "balance_change")))).alias("mismatches"), *more,
    )
    return out.withColumn("pass_rate", F.when(F.col("checked") > 0, F.col("matched") / F.col("checked")).otherwise(0.0))


def flag_mismatches(rows: DataFrame, keys: list[str] = ["doc_id"], order: str = "idx") -> DataFrame:  # noqa: B006
    """Rows that break the chain get the flag balance-mismatch, once however often this runs."""
    checked = balance_chain(rows, keys, order)
    flags = F.when(F.col("checked") & ~F.col("agrees"), F.array_union("flags", F.array(F.lit("balance-mismatch")))).otherwise(F.col("flags"))
    return checked.withColumn("flags", flags).select(*rows.columns)


def text_metrics(text: Column) -> Column:
    """Struct of characters other than space, ASCII letters and replacement characters."""
    return F.struct(F.length(F.regexp_replace(text, r"\s", "")).alias("chars"), F.length(F.regexp_replace(text, "[^A-Za-z]", "")).alias("letters"), F.length(F.regexp_replace(text, "[^�]", "")).alias("broken"))


def quality(chars: Column, letters: Column, broken: Column, pages: Column, rows: Column, checked: Column, pass_rate: Column, zero_rows: Column) -> Column:
    """needs_ocr, low_confidence or ok; the first reason holds."""
    share = lambda x: F.when(chars > 0, x / chars).otherwise(0.0)
    return (
        F.when(F.when(pages > 0, chars / pages).otherwise(0.0) < 40, "needs_ocr").when(share(letters) < 0.25, "needs_ocr").when(share(broken) > 0.03, "needs_ocr")
        .when(rows < 2, "low_confidence").when((checked >= 3) & (pass_rate < 0.8), "low_confidence").when(zero_rows > 0.5 * rows, "low_confidence").otherwise("ok")
    )


def badge(checked: Column, pass_rate: Column) -> Column:
    """Ok, partial or none."""
    return F.when((checked >= 3) & (pass_rate >= 0.98), "ok").when(checked >= 1, "partial").otherwise("none")


#: The four rules of what is good enough, each under its own name.
GOOD_ENOUGH = {
    "badge": lambda rows, checked, rate, issues: (checked >= 3) & (rate >= 0.98),
    "baseline": lambda rows, checked, rate, issues: (checked >= 3) & (rate >= 0.95),
    "command": lambda rows, checked, rate, issues: (checked > 0) & (rate >= 0.95) & (rows >= 3),
    "gate": lambda rows, checked, rate, issues: (rate >= 0.95) & (rows >= 3) & (issues <= 1),
}


def present_columns(rows: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """which columns a statement has; `amount` only without debits and credits."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = rows.groupBy(*keys).agg(
        some(F.length("iso") > 0).alias("date"), some(F.length("description") > 0).alias("description"), some(F.coalesce(F.col("debit_cents"), F.lit(0)) != 0).alias("debit"),
        some(F.coalesce(F.col("credit_cents"), F.lit(0)) != 0).alias("credit"), some(F.col("balance_cents").isNotNull()).alias("balance"),
    )
    return out.withColumn("amount", ~F.col("debit") & ~F.col("credit"))


def running_balance(rows: DataFrame, keys: list[str] = ["doc_id"], order: str = "idx") -> DataFrame:  # noqa: B006
    """Balances from a closing balance: the opening one is closing - all amounts. Null without a closing balance."""
    every, so_far = Window.partitionBy(*keys), in_order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    opening = F.col("closing_cents") - F.sum("amount_cents").over(every)
    return rows.withColumn("balance_cents", opening + F.sum("amount_cents").over(so_far)).withColumn("balance_source", F.lit("derived"))
