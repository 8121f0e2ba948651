"""Texts that are read at once against the steps that read any text."""

import random

from pyspark.sql import functions as F

from tallyspark.functions import cells
from tallyspark.functions.amounts import AMOUNT_STEPS
from tallyspark.functions.dates import FIELD_STEPS
from tallyspark.functions.text import through

TEXTS = [
    None, "", " ", "Date", "Page 3", "12.05", "1,234.56", "-1,234.56", "−1,234.56", "1.234,56", "12,34,567.89", "-0,00", "0.00", "1234,5", "1,234", "1.234", "1,2,3.45", "..12", ",12", "1,.23", "1..2,34", "99999999999999999999,99", "1" * 38 + ",25", "1" * 37 + ",25",
    "1,234.56 ", "1,234.56CR", "(1,234.56)", "$1,234.56", "EUR 5.00", "P123", "R$5", "R5", "E5", "D1", "1D", "5f", "CR5", "A1,234.56", "x1/2/2020", "Payment to P123", "Payment 5", "5 May", "May 5", "5May", "5-Ma-2020", "Mai5", "ja 5", "Sept. 12", "1 2 Jan Feb",
    "1/2/2020", "31/12/96", "12/31/1996", "1/2/3", "1/2/20201", "01/02/202", "1/2", "2020/1/2", "1-2-2020", "1.2.2020", "1/2/2020.", "1/2/2020 ", "1/2-2020", "99/99/9999", "NaN", "1e5", "é5", "Été 5", "5 août", "١٢٣", "１２.05", "Jan 5", "12.05:", "12.05,", "12:05", "1/2/2020:",
]


def test_texts_are_read_at_once_as_by_the_steps(spark):
    rnd = random.Random(7)
    made = ["".join(rnd.choice("0123456789.,-/ PJanMyEé$(") for _ in range(rnd.randint(1, 12))) for _ in range(4000)]
    made += ["".join(rnd.choice(["1", "22", "333", "4444", ".", ",", "/", "-", "P", "May", " "]) for _ in range(rnd.randint(1, 7))) for _ in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + made)], "i long, t string")
    got = cells.read_parts(df, F.col("t")).select("i", "t", "amount", "fields").orderBy("i").collect()
    want = through(df, {"amount": (F.col("t"), AMOUNT_STEPS), "fields": (F.col("t"), FIELD_STEPS)}).select("i", "t", "amount", "fields").orderBy("i").collect()
    assert len(got) == len(df.collect()) and [g for g, w in zip(got, want, strict=True) if g != w] == []
    assert sum(r.amount is not None for r in got) > 500 and sum(r.fields is not None for r in got) > 50


def test_most_runs_of_a_statement_take_no_steps(spark):
    """Amounts, dates and descriptions are told at once, by a filter before the steps."""
    texts = ["01/02/1996", "Payment to P17", "1,234.56", "-12,345.67", "1.234,56", "Account statement"]
    plan = cells.read_parts(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"))._jdf.queryExecution().analyzed()
    slow = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    at_once = (t.rlike(cells.PLAIN) & t.contains(",")) | t.rlike(cells.SLASHED) | (t.rlike(cells.NO_AMOUNT) & cells.no_date(t))
    assert slow.where(~at_once).count() == 0 and "Union" in plan.toString()
