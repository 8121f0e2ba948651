"""Clusters of numbers on a line by running means: cut at gaps, then folded between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def mean_groups(values: Column, tolerance: Column | float) -> Column:
    """A1, A5: group numbers (from 0) of ascending values. A value joins the last group if it lies within tolerance of the
    group's mean so far, else it opens a new one; a group may drift along with its mean. To join the first group within
    tolerance comes to the same: a group that one value is beyond stays behind all later ones."""
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"), F.lit(-1).alias("g"))

    def step(s: Column, v: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(v - s["sum"] / F.greatest(s["n"], F.lit(1.0))) <= tolerance)
        g = F.when(joins, s["g"]).otherwise(s["g"] + 1)
        return F.struct(F.concat(s["out"], F.array(g)).alias("out"), F.when(joins, s["sum"] + v).otherwise(v).alias("sum"), F.when(joins, s["n"] + 1.0).otherwise(F.lit(1.0)).alias("n"), g.alias("g"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def clustered(items: DataFrame, keys: list[str], value: str, tolerance: Column | float, order: list[str]) -> DataFrame:
    """items with a column `cluster`: numbers of clusters of `value` within keys, ties by the order columns. tolerance is a number
    or depends on keys.

    Values further apart than the tolerance never share a cluster, as a mean lies between its values. So values in order are cut at
    such gaps, and only a segment between them, not all of a key, meets in a row. A segment narrower than the tolerance is one
    cluster; the others are folded, which takes the square of a segment's size, as Spark copies a fold's state at each step."""
    columns = [c for c in items.columns if c not in keys]
    lists = _segments(items, keys, value, tolerance, order, F.struct(*columns).alias("_item"))
    numbered = lists.select(*keys, "_segment", F.explode(F.arrays_zip("_items", "_groups")).alias("_z"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_segment", "_group")) - 1
    return numbered.select(*keys, "_segment", "_z._items._item.*", F.col("_z._groups").alias("_group")).withColumn("cluster", number).drop("_segment", "_group")


def _segments(items: DataFrame, keys: list[str], value: str, tolerance: Column | float, order: list[str], item: Column) -> DataFrame:
    """(keys, _segment, _items, _groups): the stretches between gaps, their items in order as struct(_v, _o0, …, item), and the number within the segment of each item's cluster."""
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    v, in_order = F.col("_v"), Window.partitionBy(*keys).orderBy("_v", *order)
    cut = F.coalesce(v - F.lag("_v").over(in_order) > tolerance, F.lit(True))
    cut_up = items.withColumn("_v", F.col(value).cast("double")).withColumn("_cut", cut).withColumn("_segment", F.count_if("_cut").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    packed = F.struct("_v", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], item)
    lists = cut_up.groupBy(*keys, "_segment").agg(F.sort_array(F.collect_list(packed)).alias("_items"), (F.max("_v") - F.min("_v")).alias("_width"))
    groups = F.when(F.col("_width") < 0.999999 * tolerance, F.array_repeat(F.lit(0), F.size("_items"))).otherwise(mean_groups(F.transform("_items", lambda x: x["_v"]), tolerance))
    return lists.select(*keys, "_segment", "_items", groups.alias("_groups"))


def gathered(items: DataFrame, keys: list[str], value: str, tolerance: Column | float, order: list[str], columns: list[str]) -> DataFrame:
    """(keys, segment, part, items): a row for each cluster of clustered(), in order by segment and part, with its items as struct(columns). A segment that is one cluster is neither taken apart nor
    sorted again; in the others, clusters are slices."""
    lists = _segments(items, keys, value, tolerance, order, F.struct(*columns).alias("_item"))
    plain = F.transform("_items", lambda x: x["_item"])
    ends = F.filter(F.sequence(F.lit(1), F.size("_groups")), lambda i: (i == F.size("_groups")) | (F.get("_groups", i - 1) != F.get("_groups", i)))
    slices = F.transform(ends, lambda e, k: F.struct(k.alias("part"), F.slice(plain, F.when(k == 0, 1).otherwise(F.get(ends, k - 1) + 1), e - F.when(k == 0, 0).otherwise(F.get(ends, k - 1))).alias("items")))
    single = F.element_at("_groups", -1) == 0
    return lists.select(*keys, F.col("_segment").alias("segment"), F.inline(F.when(single, F.array(F.struct(F.lit(0).alias("part"), plain.alias("items")))).otherwise(slices)))


def middle(values: Column) -> Column:
    """The median of an array's values as F.median has it: of two in the middle their mean, null for none."""
    ordered = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    last = F.size(ordered) - 1
    return F.get(ordered, F.floor(last / 2).cast("int")) * 0.5 + F.get(ordered, F.ceil(last / 2).cast("int")) * 0.5


def median(x: Column | str) -> Column:
    """The mean of the middle two; 0 for nothing."""
    return F.coalesce(F.median(x), F.lit(0.0))


def line_pitch(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The usual distance of baselines: the median gap above 0.5 between distinct y (to a tenth), taken again over
    gaps up to twice that if there are three; 12 without any."""
    ys = runs.select(*keys, (F.floor(F.col("y") * 10 + 0.5) / 10).alias("y")).distinct()
    gaps = ys.withColumn("gap", F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("y")))
    wide = gaps.where("gap > 0.5").withColumn("m", F.median("gap").over(Window.partitionBy(*keys)))
    ordinary = F.col("gap") <= 2 * F.col("m")
    found = wide.groupBy(*keys).agg(F.when(F.count_if(ordinary) >= 3, F.median(F.when(ordinary, F.col("gap")))).otherwise(F.median("gap")).alias("pitch"))
    return runs.select(*keys).distinct().join(found, keys, "left").withColumn("pitch", F.when(F.coalesce("pitch", F.lit(0.0)) == 0, 12.0).otherwise(F.col("pitch")))
