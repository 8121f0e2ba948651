"""Deductions for tips and overtime pay, 2025 to 2028, as expressions. Public figures of the Internal Revenue Service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

FIRST_YEAR, LAST_YEAR = 2025, 2028
TIPS_CAP = 25_000
OVERTIME_CAP = {"joint": 25_000, "other": 12_500}
PHASE_OUT = {"joint": 300_000, "other": 150_000}
STEP, PER_STEP = 1_000, 100
#: The standard deduction and the lower bounds of brackets with their rates, for 2026.
STANDARD = {"mfj": 32_200, "qss": 32_200, "hoh": 24_150, "single": 16_100, "mfs": 16_100}
RATES = (0.10, 0.12, 0.22, 0.24, 0.32, 0.35, 0.37)
BOUNDS = {
    "mfj": (0, 24_800, 100_800, 211_400, 403_550, 512_450, 768_700),
    "hoh": (0, 17_700, 67_450, 105_700, 201_750, 256_200, 640_600),
    "single": (0, 12_400, 50_400, 105_700, 201_775, 256_225, 640_600),
}


def to_amount(x: Column) -> Column:
    """A positive number from a number or text with $ and commas; 0 for anything else."""
    n = F.regexp_replace(x.cast("string"), r"[$,\s]", "").try_cast("double")
    return F.when(F.coalesce(n > 0, F.lit(False)) & ~F.isnan(n) & (n < float("inf")), n).otherwise(0.0)


def by_status(status: Column, values: dict) -> Column:
    return F.when(status == "mfj", values["joint"]).otherwise(values["other"])


def phase_out(magi: Column, status: Column) -> Column:
    """100 for each full 1,000 above the threshold."""
    return F.floor(F.greatest(F.lit(0.0), to_amount(magi) - by_status(status, PHASE_OUT)) / STEP) * PER_STEP


def federal_tax(income: Column, status: Column) -> Column:
    """Tax by brackets for 2026, to cents; null for married filing separately and unknown statuses."""

    def of(table: tuple, x: Column) -> Column:
        edges = [*table[1:], float("inf")]
        parts = [F.greatest(F.lit(0.0), F.least(x, F.lit(float(hi))) - lo) * rate for lo, hi, rate in zip(table, edges, RATES, strict=True)]
        return F.floor(sum(parts[1:], parts[0]) * 100 + 0.5) / 100

    return let(to_amount(income), lambda x: F.when(status.isin("mfj", "qss"), of(BOUNDS["mfj"], x)).when(status == "hoh", of(BOUNDS["hoh"], x)).when(status == "single", of(BOUNDS["single"], x)))


def ineligible(year: Column, status: Column, valid_ssn: Column) -> Column:
    """T4: the first reason against a deduction, or null."""
    return F.when(~F.coalesce(year.between(FIRST_YEAR, LAST_YEAR), F.lit(False)), "year").when(status == "mfs", "filing-status").when(~F.coalesce(valid_ssn, F.lit(False)), "ssn")


def tax_saved(year: Column, status: Column, agi: Column, below_line: Column, deduction: Column) -> Column:
    """T5: tax before less tax after, in whole dollars; null for years other than 2026."""
    standard = F.try_element_at(F.create_map(*[F.lit(x) for kv in STANDARD.items() for x in kv]), status)

    def saved(before: Column) -> Column:
        return F.floor(federal_tax(before, status) - federal_tax(F.greatest(F.lit(0.0), before - to_amount(deduction)), status) + 0.5)

    line = F.coalesce(to_amount(F.when(below_line.isNotNull(), below_line)) if below_line is not None else None, F.lit(0.0))
    line = F.when(below_line.isNotNull(), line).otherwise(standard.cast("double"))
    return F.when((year == 2026) & (status != "mfs"), let(F.greatest(F.lit(0.0), to_amount(agi) - line), saved))


def finished(reason: Column, qualified: Column, cap: Column, magi: Column, year: Column, status: Column, below_line: Column) -> Column:
    """struct(eligible, reason, qualified, cap, capped, reduction, deduction, tax_saved)."""
    zero = F.lit(0.0)

    def build(x: Column) -> Column:
        capped, cut = F.least(x["q"], x["cap"]), x["cut"]
        left = F.greatest(zero, capped - cut)
        ok = x["reason"].isNull()
        return F.struct(
            ok.alias("eligible"), x["reason"].alias("reason"), x["q"].alias("qualified"), x["cap"].alias("cap"), F.when(ok, capped).otherwise(zero).alias("capped"), F.when(ok, F.least(cut, capped)).otherwise(zero).alias("reduction"),
            F.when(ok, left).otherwise(zero).alias("deduction"), F.when(ok, tax_saved(year, status, magi, below_line, left)).otherwise(F.lit(0)).cast("double").alias("tax_saved"),
        )

    return let(F.struct(reason.alias("reason"), qualified.cast("double").alias("q"), cap.cast("double").alias("cap"), phase_out(magi, status).cast("double").alias("cut")), build)


def overtime_premium(rate: Column, hours: Column, per_week: Column | None = None, weeks: Column | None = None) -> Column:
    """Half the regular rate for each hour, to cents; hours as given or a week's times weeks."""
    every = hours if per_week is None else F.coalesce(hours, to_amount(per_week) * to_amount(weeks))
    return F.floor(to_amount(rate) * 0.5 * to_amount(every) * 100 + 0.5) / 100


def overtime_deduction(year: Column, status: Column, valid_ssn: Column, magi: Column, amounts: Column, non_exempt: Column, below_line: Column) -> Column:
    """Amounts: an array of reported overtime; only the first counts unless the return is joint."""
    counted = F.slice(amounts, F.lit(1), F.when(status == "mfj", F.greatest(F.size(amounts), F.lit(1))).otherwise(1))
    qualified = F.aggregate(counted, F.lit(0.0), lambda s, x: s + to_amount(x))
    reason = F.when(~F.coalesce(non_exempt, F.lit(False)), "flsa-exempt").otherwise(ineligible(year, status, valid_ssn))
    return finished(reason, qualified, by_status(status, OVERTIME_CAP), magi, year, status, below_line)


def tips_deduction(year: Column, status: Column, valid_ssn: Column, magi: Column, code: Column, w2: Column, own: Column, own_profit: Column, voluntary: Column, below_line: Column) -> Column:
    """Tips of a listed occupation (three digits, not 000), voluntary ones only; those of a business up to its profit. Other tips qualify for nothing."""
    c = F.trim(F.coalesce(code, F.lit("")))
    refused = F.when(c == "000", "occupation-not-listed").when(~c.rlike(r"^\d{3}$"), "no-occupation").when(~F.coalesce(voluntary, F.lit(False)), "not-voluntary")
    business = F.when(own_profit.isNull(), to_amount(own)).otherwise(F.least(to_amount(own), to_amount(own_profit)))
    qualified = F.when(refused.isNotNull(), 0.0).otherwise(to_amount(w2) + business)
    return finished(F.coalesce(refused, ineligible(year, status, valid_ssn)), qualified, F.lit(TIPS_CAP), magi, year, status, below_line)
