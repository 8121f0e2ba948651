"""Round trips of random values."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import amounts, dates, locales
from tallyspark.sources import exports
from tallyspark.sources.ledger import printed

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.integers(-(10**11), 10**11), min_size=30, max_size=60))
def test_amounts_survive_every_market(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "cents long")
    for m in locales.MARKETS:
        for group in (False, True):
            text = locales.amount_text(exports.money(F.col("cents")), m.decimal, m.thousands, m.grouping == "indian", group)
            assert df.where(~amounts.parse_amount(text)["cents"].eqNullSafe(F.col("cents"))).count() == 0


@FEW
@given(st.lists(st.integers(-(10**11), 10**11), min_size=30, max_size=60))
def test_printed_styles_are_read_back(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "cents long").withColumn("style", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("text", F.expr(printed("cents", "style")))
    assert df.where(~amounts.parse_amount(F.col("text"))["cents"].eqNullSafe(F.col("cents"))).count() == 0


@FEW
@given(st.lists(st.dates(), min_size=30, max_size=60))
def test_dates_survive_their_formats(spark, values):
    df = spark.createDataFrame([(v,) for v in values if 1900 <= v.year <= 2200], "day date").withColumn("iso", F.date_format("day", "yyyy-MM-dd"))
    for form in dates.FORMATS:
        order = "MDY" if form.startswith("MM") else "DMY"
        # Where both readings are possible, the stated order decides.
        assert df.where(~dates.parse_date(dates.format_date(F.col("iso"), form), order)["iso"].eqNullSafe(F.col("iso"))).count() == 0
    assert df.where(dates.to_date(F.col("iso")) != F.col("day")).count() == 0
