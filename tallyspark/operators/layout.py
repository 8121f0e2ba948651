"""Rows, columns and transactions from positioned runs of text. Everything is keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import no_row, split_runs
from ..functions.dates import dated_steps, short_of_year
from ..functions.text import row_key, squeeze, strip, through
from ..session import fine_partitions, settle
from .cluster import gathered, middle


def joined_text(cells: Column, gap: Column) -> Column:
    """The texts of cells (x, w, str) in order; a blank where the gap to the one before is wide enough. Where one of the two brings a blank, squeezing leaves one. Null with a null text."""

    def told(c: Column, i: Column) -> Column:
        before = F.get(cells, i - 1)
        return F.when((i > 0) & (c["x"] - (before["x"] + before["w"]) > gap), F.concat(F.lit(" "), c["str"])).otherwise(c["str"])

    return F.when(~F.exists(cells, lambda c: c["str"].isNull()), squeeze(F.array_join(F.transform(cells, told), "")))


def told_apart(cells: Column) -> Column:
    """The cells of a row; those like 12.05 are amounts if another cell of the row is a date beyond doubt."""
    doubtful = lambda c: (c["kind"] == "date") & short_of_year(strip(c["str"])) & c["cents"].isNotNull()
    dated = F.exists(cells, lambda c: (c["kind"] == "date") & ~doubtful(c))
    fields = lambda c: F.when(~doubtful(c), c["fields"])
    return F.when(dated & F.exists(cells, doubtful), F.transform(cells, lambda c: c.withField("kind", F.when(doubtful(c), "money").otherwise(c["kind"])).withField("fields", fields(c)))).otherwise(cells)


def build_rows(runs: DataFrame) -> DataFrame:
    """A2, O1: (doc_id, page, row_no, y, height, text, cells): runs on one baseline, in reading order, split by E14 and classified by F1."""
    fine_partitions(runs.sparkSession)
    # The tolerance is half the page's usual height of type.
    usual = F.median(F.when((F.col("h") > 0) & (F.col("h") < 200), F.col("h"))).over(Window.partitionBy("doc_id", "page"))
    # Dealt out by document once: rows, their numbers and what is counted by page or document need no further shuffle.
    split = split_runs(runs).repartition("doc_id").withColumn("_m", usual).withColumn("_t", F.greatest(F.lit(1.5), 0.5 * F.when(F.coalesce("_m", F.lit(0.0)) == 0, 10.0).otherwise(F.col("_m"))))
    found = gathered(split, ["doc_id", "page", "_t"], "y", F.col("_t"), ["x", "ord"], ["x", "ord", "str", "w", "cells", "y", "h"])
    each = lambda c: F.transform("items", lambda r: r[c])
    runs_of = F.sort_array(F.transform("items", lambda r: F.struct(*[r[c].alias(c) for c in ("x", "ord", "str", "w", "cells")])))
    rows = found.select("doc_id", "page", "segment", "part", middle(each("y")).alias("y"), middle(each("h")).alias("height"), runs_of.alias("_runs"))
    text, cells = joined_text(F.col("_runs"), F.greatest(F.lit(1.2), 0.18 * F.col("height"))), F.flatten(F.transform("_runs", lambda r: r["cells"]))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "segment", "part")) - 1
    rows = rows.select("doc_id", "page", "segment", "part", "y", "height", text.alias("text"), cells.alias("cells")).withColumn("cells", told_apart(F.col("cells")))
    return rows.select("doc_id", "page", number.cast("long").alias("row_no"), "y", "height", "text", "cells")


def _bands(cells: DataFrame, edge: Column, tolerance: str) -> DataFrame:
    """A3, A4: clusters of two or more cells: (doc_id, left, right, anchor, n)."""
    found = gathered(cells.withColumn("_edge", edge).withColumn("_ord", F.col("x")), ["doc_id", tolerance], "_edge", F.col(tolerance), ["row_no", "_ord"], ["x", "w", "_edge"]).where(F.size("items") >= 2)
    each = lambda of: F.transform("items", of)
    mean = F.aggregate(each(lambda c: c["_edge"]), F.lit(0.0), lambda s, v: s + v) / F.size("items")
    return found.select("doc_id", F.array_min(each(lambda c: c["x"])).alias("left"), F.array_max(each(lambda c: c["x"] + c["w"])).alias("right"), mean.alias("anchor"), F.size("items").cast("long").alias("n"))


def nearest(at: Column, bands: Column, tolerance: float = 10.0) -> Column:
    """Of bands (left, right, anchor) in order, the one whose anchor is nearest to `at`, among those that hold it; the first of equally near ones; null if none."""
    near = F.filter(bands, lambda b: (at >= b["left"] - tolerance) & (at <= b["right"] + tolerance))
    least = F.array_min(F.transform(near, lambda b: F.abs(b["anchor"] - at)))
    return F.get(F.filter(near, lambda b: F.abs(b["anchor"] - at) == least), F.lit(0))


def in_band(at: Column, bands: Column, tolerance: float = 6.0) -> Column:
    """whether a place lies in any of the bands."""
    return F.exists(bands, lambda b: (at >= b["left"] - tolerance) & (at <= b["right"] + tolerance))


def _labelled(bands: Column, labels: Column, body: Column, edge: str) -> Column:
    """Bands with label and task of the nearest heading, right edges for money, left ones for dates."""

    def name(b: Column) -> Column:
        off = lambda h: F.abs((h["right"] if edge == "right" else h["x"]) - b[edge])
        near = F.filter(labels, lambda h: off(h) <= F.greatest(F.lit(24.0), 2.4 * body))
        hit = F.get(F.filter(near, lambda h: off(h) == F.array_min(F.transform(near, off))), F.lit(0))
        return F.struct(b["left"].alias("left"), b["right"].alias("right"), b["anchor"].alias("anchor"), b["n"].alias("n"), b["id"].alias("id"), hit["str"].alias("label"), hit["task"].alias("task"))

    return F.transform(bands, name)


def detect_columns(rows: DataFrame) -> DataFrame:
    """One row for each document: body, table_left, table_right, header_row, header, date_bands, money_bands, desc_left, desc_right."""
    # Rows are read once: what columns are found by is saved, and that is a small part of them.
    labels = F.filter(F.transform("cells", lambda c: F.struct(strip(c["str"]).alias("str"), c["x"].alias("x"), (c["x"] + c["w"]).alias("right"), c["task"].alias("task"))), lambda h: h["task"].isNotNull())
    kinds = F.transform(F.filter("cells", lambda c: c["kind"].isin("date", "money", "weak_number")), lambda c: F.struct(c["x"].alias("x"), c["w"].alias("w"), c["kind"].alias("kind")))
    brief = settle(rows.select(
        "doc_id", "row_no", "height", F.array_min(F.transform("cells", lambda c: c["x"])).alias("left"), F.array_max(F.transform("cells", lambda c: c["x"] + c["w"])).alias("right"), kinds.alias("cells"), F.when(F.col("row_no") < 60, labels).alias("labels"),
    ))
    money = F.sum(F.size(F.filter("cells", lambda c: c["kind"] == "money"))).alias("n_money")
    base = brief.groupBy("doc_id").agg(F.median(F.when((F.col("height") > 0) & (F.col("height") < 200), F.col("height"))).alias("body"), F.min("left").alias("table_left"), F.max("right").alias("table_right"), money)
    base = base.withColumn("body", F.when(F.coalesce("body", F.lit(0.0)) == 0, 10.0).otherwise(F.col("body"))).withColumns({"date_t": F.greatest(F.lit(6.0), 0.9 * F.col("body")), "money_t": F.greatest(F.lit(5.0), 0.7 * F.col("body"))})

    heads = brief.select("doc_id", "row_no", "labels").withColumn("tasks", F.size(F.array_distinct(F.transform("labels", lambda h: h["task"])))).where("tasks >= 2")
    header = heads.groupBy("doc_id").agg(F.max_by(F.struct("row_no", "labels"), F.struct("tasks", -F.col("row_no"))).alias("h")).select("doc_id", F.col("h.row_no").alias("header_row"), F.col("h.labels").alias("header"))

    cells = brief.select("doc_id", "row_no", F.inline("cells"))
    typed = cells.join(base.select("doc_id", "date_t", "money_t", "n_money"), "doc_id")
    # With fewer than three amounts, weak numbers count as amounts.
    money = typed.where("kind = 'money' or (kind = 'weak_number' and n_money < 3)")
    listed = lambda b, name, kind: b.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("left", "right", "anchor", "n"))).alias(name)).withColumn(name, F.transform(name, lambda x, i: F.struct(x["left"].alias("left"), x["right"].alias("right"), x["anchor"].alias("anchor"), x["n"].alias("n"), F.concat(F.lit(f"{kind}-"), i.cast("string")).alias("id"))))
    dates = listed(_bands(typed.where("kind = 'date'"), F.col("x"), "date_t"), "date_bands", "date")
    amounts = listed(_bands(money, F.col("x") + F.col("w"), "money_t"), "money_bands", "money")
    none = F.array().cast("array<struct<left:double,right:double,anchor:double,n:bigint,id:string>>")
    out = base.join(header, "doc_id", "left").join(dates, "doc_id", "left").join(amounts, "doc_id", "left")
    out = out.withColumns({"date_bands": F.coalesce("date_bands", none), "money_bands": F.coalesce("money_bands", none), "header": F.coalesce("header", F.array().cast("array<struct<str:string,x:double,right:double,task:string>>"))})
    out = out.withColumns({"date_bands": _labelled(F.col("date_bands"), F.col("header"), F.col("body"), "left"), "money_bands": _labelled(F.col("money_bands"), F.col("header"), F.col("body"), "right")})
    left = F.coalesce(F.get("date_bands", F.lit(0))["right"], F.col("table_left"))
    first_money = F.coalesce(F.array_min(F.transform("money_bands", lambda b: b["left"])), F.col("table_right"))
    label = F.get(F.filter("header", lambda h: h["task"] == "description"), F.lit(0))
    return out.select(
        "doc_id", "body", "table_left", "table_right", "header_row", "header", "date_bands", "money_bands",
        F.coalesce(label["x"] - 0.6 * F.col("body"), left).alias("desc_left"), F.greatest(left, first_money - 0.5 * F.col("body")).alias("desc_right"),
    )


def furniture(rows: DataFrame) -> DataFrame:
    """rows with `noise`: whether the same text stands at the same height on most pages, dates excepted."""
    has_date = F.exists("cells", lambda c: c["kind"] == "date")
    keyed = rows.withColumn("_key", row_key(F.col("text"))).withColumn("_at", F.floor(F.col("y") / 6 + 0.5)).withColumn("has_date", has_date)
    pages = Window.partitionBy("doc_id")
    total = F.size(F.collect_set("page").over(pages))
    on = F.size(F.collect_set("page").over(Window.partitionBy("doc_id", "_key", "_at")))
    noise = (total >= 2) & (F.col("_key") != "") & (on >= F.greatest(F.lit(2), F.ceil(0.6 * total))) & ~F.col("has_date")
    return keyed.withColumn("noise", noise).select(*rows.columns, "noise", "has_date")


def table_window(rows: DataFrame) -> DataFrame:
    """rows with `in_table`: whether a row lies between its page's first and last dates, four rows' height allowed for."""
    pad = F.greatest(F.lit(6.0), 4 * F.coalesce(F.nullif(F.median("height").over(Window.partitionBy("doc_id")), F.lit(0.0)), F.lit(10.0)))
    page, y = Window.partitionBy("doc_id", "page"), F.when(F.col("has_date"), F.col("y"))
    inside = (F.col("y") >= F.min(y).over(page) - pad) & (F.col("y") <= F.max(y).over(page) + pad)
    return rows.withColumn("in_table", F.coalesce(inside, F.lit(False)))


def assemble(rows: DataFrame, model: DataFrame, orders: DataFrame) -> DataFrame:
    """(doc_id, idx, page, row_no, iso, date_raw, description, raw_text, flags, money, money_bands): a transaction for each dated
    row, with the rows below it. orders(doc_id, date_order, year): how dates are read."""
    r = table_window(furniture(rows)).where("not noise").join(model.select("doc_id", "date_bands", "money_bands"), "doc_id").join(orders, "doc_id")
    centre = lambda c: c["x"] + c["w"] / 2
    dated = F.get(F.filter("cells", lambda c: (c["kind"] == "date") & in_band(centre(c), F.col("date_bands"))), F.lit(0))
    words = F.filter(F.transform(F.filter("cells", lambda c: ~in_band(centre(c), F.col("date_bands"), 4) & ~in_band(centre(c), F.col("money_bands"), 4)), lambda c: strip(c["str"])), lambda s: s != "")
    amounts = F.transform(F.filter("cells", lambda c: c["kind"].isin("money", "weak_number")), lambda c: F.struct(nearest(centre(c), F.col("money_bands"))["id"].alias("band"), c["cents"].alias("cents")))
    amounts = F.filter(amounts, lambda m: m["band"].isNotNull())
    r = r.select("doc_id", "page", "row_no", "text", "in_table", "date_order", "year", dated["str"].alias("date_cell"), dated["fields"].alias("date_fields"), squeeze(F.array_join(words, " ")).alias("words"), amounts.alias("money"), "money_bands")
    r = through(r, {"iso": (F.col("date_fields"), [*dated_steps(F.col("date_order"), F.col("year")), lambda d: d["iso"]])})
    opens = F.col("iso").isNotNull()
    r = r.withColumn("idx", F.count_if(opens).over(Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)))
    r = r.where(opens | ((F.col("idx") > 0) & F.col("in_table") & ~no_row(F.col("text"))))
    below = F.sort_array(F.collect_list(F.when(~opens, F.struct("row_no", "words", "money"))))
    t = r.groupBy("doc_id", "idx").agg(*[F.any_value(F.when(opens, F.col(c)), ignoreNulls=True).alias(c) for c in ("page", "row_no", "iso", "date_cell", "words", "text", "money", "money_bands")], below.alias("below"))
    added = F.filter(F.transform("below", lambda b: b["words"]), lambda s: (s != "") & (F.length(s) <= 160))
    adopted = F.get(F.filter(F.transform("below", lambda b: b["money"]), lambda m: F.size(m) > 0), F.lit(0))
    adopts = (F.size("money") == 0) & adopted.isNotNull()
    flags = F.concat(F.transform(added, lambda s: F.lit("multiline-description")), F.when(adopts, F.array(F.lit("amount-on-continuation-row"))).otherwise(F.array().cast("array<string>")))
    return t.select(
        "doc_id", "idx", "page", "row_no", "iso", strip(F.col("date_cell")).alias("date_raw"), F.trim(F.array_join(F.concat(F.array("words"), added), " ")).alias("description"), F.col("text").alias("raw_text"),
        flags.alias("flags"), F.when(adopts, adopted).otherwise(F.col("money")).alias("money"), "money_bands",
    )
