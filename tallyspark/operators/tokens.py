"""Words of statements as positioned tokens, their neighbours, and the lines of figures that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import money_reading, money_word
from ..functions.cells import read_parts
from ..functions.dates import FIELD_STEPS, dated_steps, short_of_year
from ..functions.text import SPACE, strip, through
from ..session import fine_partitions, settle
from .cluster import clustered, line_pitch

WORD = rf"(?:(?!{SPACE}).)+"


def tokenise(runs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, ord, n, text, x, y, width, height, x1, y1, x2, y2, estimated), and the carried columns of the run: a row for each word of a run; places within a run
    go by even advance and are estimated where the run has several words."""
    fine_partitions(runs.sparkSession)
    words = F.filter(F.split(F.col("str"), f"{SPACE}+"), lambda w: w != "")
    gaps = F.filter(F.split(F.col("str"), f"(?s){WORD}"), lambda g: g.isNotNull())
    step = F.when(F.length("str") > 0, F.col("w") / F.length("str")).otherwise(0.0)
    listed = runs.select("doc_id", "page", "ord", "x", "y", "w", "h", F.length("str").alias("size"), step.alias("step"), words.alias("words"), gaps.alias("gaps"), *carried)
    joined = lambda a, n: F.length(F.array_join(F.slice(a, F.lit(1), n), ""))
    t = listed.select("*", F.posexplode("words").alias("n", "text")).withColumn("start", joined("words", F.col("n")) + joined("gaps", F.col("n") + 1))
    height = F.when(F.coalesce("h", F.lit(0.0)) == 0, 10.0).otherwise(F.col("h"))
    t = t.withColumn("width", F.when(F.col("step") > 0, F.length("text") * F.col("step")).otherwise(F.col("w"))).withColumn("x", F.col("x") + F.col("start") * F.col("step")).withColumn("height", height)
    return t.select(
        "doc_id", "page", "ord", "n", "text", "x", "y", "width", "height", F.col("x").alias("x1"), (F.col("y") - 0.8 * F.col("height")).alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + 0.25 * F.col("height")).alias("y2"),
        (F.size("words") > 1).alias("estimated"), *carried,
    )


def metrics(runs: DataFrame) -> DataFrame:
    """(doc_id, pitch, font): medians over pages of the line pitch and of the height of type."""
    pages = line_pitch(runs, ["doc_id", "page"])
    fonts = runs.groupBy("doc_id", "page").agg(F.median(F.when((F.col("h") > 0) & (F.col("h") < 200), F.col("h"))).alias("font"))
    both = pages.join(fonts, ["doc_id", "page"]).groupBy("doc_id").agg(F.median("pitch").alias("pitch"), F.median(F.coalesce("font", F.lit(10.0))).alias("font"))
    positive = lambda c, d: F.when(F.coalesce(c, F.lit(0.0)) == 0, d).otherwise(F.col(c))
    return both.select("doc_id", positive("pitch", 12.0).alias("pitch"), positive("font", 10.0).alias("font"))


def measured(runs: DataFrame) -> DataFrame:
    """tokenise() with the document's metrics(). Runs, which are fewer than tokens, are dealt out by document, so what goes by page, line or document needs no further shuffle."""
    fine_partitions(runs.sparkSession)
    return tokenise(runs.repartition("doc_id").join(metrics(runs), "doc_id"), ("pitch", "font"))


#: Texts that hold one amount beyond doubt: thousands in groups, and two decimals.
AMOUNT = r"^[(-]?(?:[0-9]{1,3}(?:,[0-9]{2,3})*,[0-9]{3}\.|[0-9]{1,3}(?:\.[0-9]{3})+,)[0-9]{2}\)?(?: CR| DR)?$"


def short_documents(runs: DataFrame, most: int) -> DataFrame:
    """The runs of documents that may have at most `most` figures: a document with more runs that are amounts beyond doubt has more. Most long documents need not be read further, though
    some of those that stay turn out to be long."""
    sure = runs.groupBy("doc_id").agg(F.count_if(F.col("str").rlike(AMOUNT)).alias("_sure"))
    return runs.join(sure.where(F.col("_sure") <= most).select("doc_id"), "doc_id", "left_semi")


def band_pairs(tokens: DataFrame, reach: Column) -> DataFrame:
    """(doc_id, page, a, b): pairs of tokens of a page whose heights differ by at most `reach`: heights are cut into bands of that width, and a band's tokens meet in a row those
    of the bands above and below. So nothing is copied or shuffled on the way to pairs but what deals tokens out by document or page. a and b are structs of all columns."""
    t = tokens.withColumn("reach", reach).withColumn("band", F.floor(F.col("y") / F.col("reach")).cast("long")).where("doc_id is not null and page is not null and band is not null")
    bands = t.groupBy("doc_id", "page", "band").agg(F.collect_list(F.struct(*t.columns)).alias("own"))
    down = Window.partitionBy("doc_id", "page").orderBy("band")

    def beside(shift: int) -> Column:
        at = lambda c: F.lag(c, -shift).over(down)
        return F.when(at("band") == F.col("band") + shift, at("own"))

    near = bands.select("doc_id", "page", "own", F.array_compact(F.array(beside(-1), F.col("own"), beside(1))).alias("near"))
    pairs = near.select("doc_id", "page", "near", F.explode("own").alias("a")).select("doc_id", "page", "a", F.explode("near").alias("_band")).select("doc_id", "page", "a", F.explode("_band").alias("b"))
    return pairs.where(F.abs(F.col("a.y") - F.col("b.y")) <= F.col("a.reach"))


ID = ("doc_id", "page", "ord", "n")


def first() -> list[Column]:
    """What the first token of a pair is known by."""
    return [F.col("doc_id"), F.col("page"), F.col("a.ord").alias("ord"), F.col("a.n").alias("n")]


def _other(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.ord") != F.col(f"{b}.ord")) | (F.col(f"{a}.n") != F.col(f"{b}.n"))


def same_baseline(tokens: DataFrame) -> DataFrame:
    """Pairs of other tokens on a token's line. tokens carry the document's `pitch`."""
    return band_pairs(tokens, F.greatest(F.lit(0.5), 0.5 * F.col("pitch"))).where(_other())


def neighbours(pairs: DataFrame) -> DataFrame:
    """For each token with others on its line the nearest one to the right and to the left, by the place where they start."""
    to = lambda c, d: F.when(c, F.struct((d * F.col("b.x")).alias("x"), F.col("b.ord").alias("ord"), F.col("b.n").alias("n"), F.col("b.text").alias("text")))
    return pairs.groupBy(*first()).agg(F.min(to(F.col("b.x") > F.col("a.x"), F.lit(1.0)))["text"].alias("right_of"), F.min(to(F.col("b.x") < F.col("a.x"), F.lit(-1.0)))["text"].alias("left_of"))


def stacked_below(tokens: DataFrame) -> DataFrame:
    """Pairs of a token and one up to 1.4 lines below it whose horizontal extents overlap."""
    pairs = band_pairs(tokens, 1.4 * F.col("pitch"))
    return pairs.where((F.col("b.y") > F.col("a.y")) & (F.col("b.x1") < F.col("a.x2")) & (F.col("b.x2") > F.col("a.x1")))


def day_months(tokens: DataFrame) -> DataFrame:
    """tokens with `fields`, what the date frames make of their text without a closing comma or semicolon."""
    return through(tokens, {"fields": (F.regexp_replace(strip(F.col("text")), "[,;]$", ""), FIELD_STEPS)})


def stacked_years(tokens: DataFrame) -> DataFrame:
    """Two numbers framed as a day and a month, with a year of this or the last century below them: (doc_id, ord, n, year)."""
    t = tokens if "fields" in tokens.columns else day_months(tokens)
    year = F.when(F.length("text") == 4, F.col("text").try_cast("int"))
    fragment = (F.col("fields.shape") == "numbers") & F.col("fields.year").isNull()
    side = F.when(fragment, 0).when(year.between(1900, 2099), 1)
    marked = t.withColumn("side", side).where("side is not null").drop("fields")
    return stacked_below(marked).where("a.side = 0 and b.side = 1").groupBy(*first()).agg(F.min(F.struct("b.ord", "b.text"))["text"].cast("int").alias("year"))


def visual_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, y, seed_ord, seed_n, tokens): in reading order, a token that no line holds yet opens one with all tokens of its page within half
    a pitch of its height, those of other lines as well; lines from the top by the height of their leftmost token, tokens from the left.

    Tokens of one height open or don't as one, and heights further apart than the reach don't touch each other. So heights are cut at such gaps, and the
    order is followed within a segment only. tokens carry the document's `pitch`; ties of place go by ord and n."""
    reach = F.greatest(F.lit(0.5), 0.5 * F.col("pitch"))
    down = Window.partitionBy("doc_id", "page").orderBy("y")
    # Lines that hold a height lie in its segment, so tokens go with their heights and meet no other row.
    heights = tokens.where("doc_id is not null and page is not null and y is not null").groupBy("doc_id", "page", "y", reach.alias("reach")).agg(F.min(F.struct("ord", "n")).alias("first"), F.collect_list(F.struct("x", "ord", "n", "y", "text")).alias("tokens"))
    cut = F.coalesce(F.col("y") - F.lag("y").over(down) > F.col("reach"), F.lit(True))
    segments = heights.withColumn("_cut", cut).withColumn("segment", F.count_if("_cut").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    listed = segments.groupBy("doc_id", "page", "reach", "segment").agg(F.sort_array(F.collect_list(F.struct("first", "y", "tokens"))).alias("heights"))
    none = F.expr("cast(array() as array<struct<first:struct<ord:bigint,n:int>,y:double>>)")
    in_order = F.transform("heights", lambda h: F.struct(h["first"].cast("struct<ord:bigint,n:int>").alias("first"), h["y"].alias("y")))
    opened = F.aggregate(in_order, none, lambda s, h: F.when(F.exists(s, lambda o: F.abs(o["y"] - h["y"]) <= F.col("reach")), s).otherwise(F.array_append(s, h)))
    held = lambda o: F.flatten(F.transform(F.filter("heights", lambda h: F.abs(h["y"] - o["y"]) <= F.col("reach")), lambda h: h["tokens"]))
    lines = listed.withColumn("_seeds", opened).select("doc_id", "page", F.inline(F.transform("_seeds", lambda o: F.struct(o["first"]["ord"].alias("seed_ord"), o["first"]["n"].alias("seed_n"), F.sort_array(held(o)).alias("tokens"))))).withColumn("y", F.get("tokens", F.lit(0))["y"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "seed_ord", "seed_n")) - 1
    return lines.select("doc_id", "page", number.cast("long").alias("line_no"), "y", "seed_ord", "seed_n", "tokens")


def beside_date(tokens: DataFrame, dated: str, text: Column) -> DataFrame:
    """tokens without their column `dated` (whether they read as a date), with `is_date`: those like 12.05 are none if a date beyond doubt stands on their line. Tokens are on one line if no
    step from height to height between them is more than half the height of type."""
    down, doubtful = Window.partitionBy("doc_id", "page").orderBy("y"), F.col(dated) & short_of_year(text)
    t = tokens.withColumn("_doubtful", doubtful).withColumn("_step", F.coalesce(F.col("y") - F.lag("y").over(down) > F.greatest(F.lit(0.5), 0.5 * F.col("height")), F.lit(False)).cast("int"))
    t = t.withColumn("_line", F.sum("_step").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    sure = F.max(F.col(dated) & ~F.col("_doubtful")).over(Window.partitionBy("doc_id", "page", "_line"))
    return t.withColumn("is_date", F.col(dated) & ~(F.col("_doubtful") & sure)).drop(dated, "_doubtful", "_step", "_line")


def read_words(tokens: DataFrame) -> DataFrame:
    """tokens that have a digit, as all amounts and dates do, with `amount` (parse_amount() of the word without a closing comma, semicolon or colon) and `fields` (what the date frames make of it)."""
    some = tokens.where(F.col("text").rlike("[0-9]"))
    return read_parts(some, money_word(F.col("text")))


def _dates(read: DataFrame) -> DataFrame:
    """read_words() with `_date` in place of fields' reading: whether the word is a date."""
    placed = through(read, {"_date": (F.col("fields"), dated_steps("DMY"))})
    return placed.withColumn("_date", F.col("_date").isNotNull())


def money_candidates(tokens: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Tokens that may be money, with `r` (the reading), the column of their right edge, its support and their confidence. read: read_words() of tokens with `_date`, where only what lines
    hold is wanted."""
    t = _dates(read_words(tokens)) if read is None else read
    # Words without a digit are there as heights only, by which lines go.
    others = tokens.where(~F.col("text").rlike("[0-9]")).select("doc_id", "page", "y", "height").distinct()
    t = beside_date(t.withColumnRenamed("_date", "_dated").unionByName(others.withColumns({"text": F.lit(""), "_dated": F.lit(False)}), allowMissingColumns=True), "_dated", money_word(F.col("text")))
    t = t.withColumn("r", money_reading(F.col("text"), F.col("amount"), F.col("is_date"))).drop("amount", "fields", "is_date").where("r is not null").withColumn("right", F.col("x") + F.col("width"))
    if read is not None:
        # What lines hold, so that clusters pack no more.
        t = t.select("doc_id", "page", "ord", "n", "x", "y", "right", "font", F.struct(*[F.col("r")[c].alias(c) for c in ("value", "magnitude", "has_sign", "confidence")]).alias("r"))
    t = t.withColumn("reach", F.greatest(F.lit(1.5), 0.35 * F.col("font")))
    t = clustered(t, ["doc_id", "reach"], "right", F.col("reach"), ["page", "ord", "n"])
    members = F.count("*").over(Window.partitionBy("doc_id", "cluster"))
    return t.withColumn("support", F.least(F.lit(1.0), (members - 1) / 3)).withColumn("confidence", F.least(F.lit(1.0), F.col("r.confidence") + 0.45 * F.least(F.lit(1.0), members / 6)))


def build_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, line_no, page, y, money, dated): lines with money, each token in one line only: from the top, a line starts at the first token that no line
    holds yet and takes what lies within half a pitch below. Words are read once, and only what lines hold of them, by height, goes on to pages."""
    t = tokens.select("doc_id", "page", "ord", "n", "text", "x", "y", "width", "height", "x1", "x2", "pitch", "font")
    read = settle(_dates(read_words(t)))
    # A colon stays where only a comma or a semicolon comes off, and no date ends with one.
    plain = ~strip(F.col("text")).endswith(":")
    stacked = stacked_years(read.select("doc_id", "page", "ord", "n", "text", "y", "x1", "x2", "pitch", F.when(plain, F.col("fields")).alias("fields")))
    lows = read.select(*ID, "y").join(stacked.select(*ID), list(ID), "left_semi")
    figure = F.struct("x", "ord", "n", F.struct("x", "ord", "n", F.col("r.value").alias("value"), F.col("r.magnitude").alias("magnitude"), F.col("r.has_sign").alias("has_sign"), "confidence", "support", F.col("cluster").alias("column")).alias("m"))
    none = F.lit(None).cast("boolean")
    heights = t.select("doc_id", "page", "y", F.greatest(F.lit(0.5), 0.5 * F.col("pitch")).alias("reach")).distinct()
    dated = read.where(F.col("_date") & plain).select("doc_id", "page", "y").unionByName(lows.select("doc_id", "page", "y")).distinct().withColumn("dated", F.lit(True))
    money = money_candidates(t, read).select("doc_id", "page", "y", figure.alias("f"))
    parts = heights.withColumn("dated", none).unionByName(dated, allowMissingColumns=True).unionByName(money, allowMissingColumns=True).repartition("doc_id")
    by_height = parts.groupBy("doc_id", "page", "y").agg(F.max("reach").alias("reach"), F.coalesce(F.bool_or("dated"), F.lit(False)).alias("dated"), F.collect_list("f").alias("f"))
    # Lines open by the distance to their first token, so this is a fold over heights in order.
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("double").alias("y"), F.lit(-1).alias("g"))

    def step(s: Column, v: Column) -> Column:
        stays = s["y"].isNotNull() & (v["y"] - s["y"] <= v["reach"])
        g = F.when(stays, s["g"]).otherwise(s["g"] + 1)
        return F.struct(F.concat(s["out"], F.array(g)).alias("out"), F.when(stays, s["y"]).otherwise(v["y"]).alias("y"), g.alias("g"))

    pages = by_height.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("y", "reach", "dated", "f"))).alias("h"))
    opened = F.aggregate(F.transform("h", lambda v: F.struct(v["y"].alias("y"), v["reach"].alias("reach"))), start, step, lambda s: s["out"])
    each = pages.select("doc_id", "page", F.explode(F.arrays_zip("h", opened.alias("g"))).alias("z")).select("doc_id", "page", F.col("z.g").alias("line"), "z.h.*")
    out = each.groupBy("doc_id", "page", "line").agg(F.min("y").alias("y"), F.bool_or("dated").alias("dated"), F.sort_array(F.flatten(F.collect_list("f"))).alias("all"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y")) - 1
    return out.select("doc_id", number.cast("long").alias("line_no"), "page", "y", "dated", F.transform("all", lambda a: a["m"]).alias("money"))
