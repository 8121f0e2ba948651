"""The decoder's search as rows: a frontier of states for all documents together, one join a line.

The same search as in decode.py, held where it can be looked at and where any number of documents share each step. A state is a row
(doc_id, anchor, total) with its score and the roles that led to it. A line's figures extend it within its row; states of a document
with one anchor and sum are merged into the best, ranked, and cut. Each step saves the states that go
on, so that lost executors repeat one step only, until the next one has been saved; what a result tells of a step is a few rows of it.
The number of steps is that of the longest document's lines; steps of a document end with its own last line.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, settle
from .beams import LETTERS, SIDE_BY_SIDE, Beams
from .decode import ROLES, Weights

STATE = "struct<anchor:bigint,total:bigint,span:int,support:double,score:double,path:bigint,roles:string>"
#: Documents of a task: as many as have so many states together, but LEAST at least.
STATES, LEAST = 16_000, 20


def figures_of(lines: DataFrame, w: Weights = Weights()) -> DataFrame:  # noqa: B008
    """(doc_id, step, line_no, last, figures) of the lines(doc_id, line_no, money) that have money: figures carry cents, size, has_sign, confidence,
    support and whether they are eligible for a role: those sure enough, the roles_per_line surest of a line."""
    cents = lambda x: F.floor(x * 100 + 0.5).cast("bigint")
    sure = F.slice(F.reverse(F.sort_array(F.transform("money", lambda m, i: F.struct(m["confidence"].alias("c"), (-i).alias("i"))))), 1, w.roles_per_line)
    eligible = lambda m, i: (m["confidence"] >= w.least_confidence) & F.exists(sure, lambda s: s["i"] == -i)
    listed = F.transform("money", lambda m, i: F.struct(cents(m["value"]).alias("value"), cents(m["magnitude"]).alias("size"), m["has_sign"].alias("has_sign"), m["confidence"].alias("confidence"), m["support"].alias("support"), eligible(m, i).alias("eligible")))
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    some = lines.where(F.size("money") > 0)
    return some.select("doc_id", F.row_number().over(by_line).alias("step"), "line_no", F.lead("line_no").over(by_line).isNull().alias("last"), listed.alias("figures"))


def _extended(states: Column, m: Column, w: Weights) -> Column:
    """The states after figure m got each of its roles; a path counts the roles of eligible figures in base ROLES."""
    value, cost = m["value"], w.amount * m["confidence"] * (1 + w.isolation * (1 - m["support"]))

    def choices(s: Column) -> Column:
        def state(role: int, score: Column, **new: Column) -> Column:
            kept = {"anchor": s["anchor"], "total": s["total"], "span": s["span"], "support": s["support"]} | new
            path = F.when(m["eligible"], s["path"] * ROLES + role).otherwise(s["path"])
            return F.struct(*[c.alias(k) for k, c in kept.items()], score.alias("score"), path.alias("path"), F.concat(s["roles"], F.lit(LETTERS[role])).alias("roles")).cast(STATE)

        amount = lambda role, by: state(role, s["score"] - cost, total=s["total"] + by, span=s["span"] + 1, support=s["support"] + m["support"])
        anew = {"anchor": value, "total": F.lit(0), "span": F.lit(0), "support": F.lit(0.0)}
        quality = F.greatest(F.lit(w.least_quality), F.least(m["support"], F.when(s["span"] > 0, s["support"] / s["span"]).otherwise(0.0)))
        fits = s["anchor"].isNotNull() & (F.abs(s["anchor"] + s["total"] - value) <= w.tolerance)
        return F.array_compact(F.array(
            state(0, s["score"] - m["confidence"] * m["confidence"] * w.unexplained),
            F.when(m["eligible"], amount(1, F.when(m["has_sign"] & (value < 0), -m["size"]).otherwise(m["size"]))),
            F.when(m["eligible"] & ~m["has_sign"], amount(2, -m["size"])),
            F.when(m["eligible"], state(3, s["score"] - w.chain_start, **anew)),
            F.when(m["eligible"] & fits, state(4, s["score"] + (w.constraint + w.span * s["span"]) * quality, **anew)),
        ))

    return F.flatten(F.transform(states, choices))


def search(figures: DataFrame, w: Weights = Weights(), watched: DataFrame | None = None, least: int = LEAST) -> dict[str, DataFrame]:  # noqa: B008
    """The search over figures_of(), with at least so many documents a task, as

    * trace(doc_id, step, states, cutoff): how many states a step found, and the score of the last one kept if some were dropped;
    * best(doc_id, score, roles, pruned): the best state behind the last line, and whether any step dropped states;
    * ranks(doc_id, step, anchor, total, rank): where the watched(doc_id, step, anchor, total) states stood before the cut, from 1 on; null if they were
      not found."""
    steps, documents = figures.agg(F.max("step"), F.count_if(F.col("step") == 1)).first()
    # Dealt out by document once: no step shuffles, and a task sorts what so many documents grow to, however many there are in all.
    figures, steps = settle(figures.repartition(max(1, -(-documents // max(least, STATES // w.max_states))), "doc_id")), steps or 0
    start = F.struct(F.lit(None).alias("anchor"), F.lit(0).alias("total"), F.lit(0).alias("span"), F.lit(0.0).alias("support"), F.lit(0.0).alias("score"), F.lit(0).alias("path"), F.lit("").alias("roles")).cast(STATE)
    front = figures.where("step = 1").select("doc_id", start.alias("s"), F.lit(False).alias("pruned"))
    within, found, before = Window.partitionBy("doc_id"), [], None
    grow = F.explode(F.aggregate("figures", F.array("s"), lambda states, m: _extended(states, m, w))).alias("s")
    best, rank = F.max_by("s", F.struct(F.col("s.score"), -F.col("s.path"))), F.row_number().over(within.orderBy(F.desc("s.score"), "first"))
    for step in range(1, steps + 1):
        line = figures.where(F.col("step") == step).select("doc_id", "step", "last", "figures")
        grown = front.join(line, "doc_id").select("doc_id", "step", "last", "pruned", grow)
        merged = grown.groupBy("doc_id", "step", "last", "pruned", F.col("s.anchor").alias("anchor"), F.col("s.total").alias("total")).agg(best.alias("s"), F.min("s.path").alias("first"))
        ranked = merged.withColumn("rank", rank.cast("long")).withColumn("states", F.count("*").over(within))
        if watched is None:
            ranked = ranked.withColumn("watched", F.lit(False))
        else:
            here = watched.where(F.col("step") == step).select(F.col("doc_id").alias("_doc"), F.col("anchor").alias("_anchor"), F.col("total").alias("_total"), F.lit(True).alias("watched")).distinct()
            ranked = ranked.join(here, (F.col("doc_id") == F.col("_doc")) & F.col("anchor").eqNullSafe(F.col("_anchor")) & (F.col("total") == F.col("_total")), "left").withColumn("watched", F.coalesce("watched", F.lit(False)))
        goes_on = (F.col("rank") <= w.max_states) & (~F.col("last") | (F.col("rank") == 1) | (F.col("rank") == w.max_states))
        kept = settle(ranked.where(goes_on | F.col("watched")).select("doc_id", "step", "last", "pruned", "anchor", "total", "s", "rank", "states", "watched"))
        found.append(settle(kept.where(F.col("rank").isin(1, w.max_states) | F.col("watched")).select("doc_id", "step", "last", "pruned", "anchor", "total", F.col("s.score").alias("score"), F.when(F.col("last"), F.col("s.roles")).alias("roles"), "rank", "states")))
        if before is not None:
            forget(before)
        before, pruned = kept, F.col("pruned") | (F.col("states") > w.max_states)
        front = kept.where((F.col("rank") <= w.max_states) & ~F.col("last")).select("doc_id", F.col("s").withField("path", F.col("rank") - 1).alias("s"), pruned.alias("pruned"))
    if before is not None:
        forget(before)
    none = figures.select("doc_id", "step", "last", F.lit(False).alias("pruned"), start["anchor"].alias("anchor"), start["total"].alias("total"), start["score"].alias("score"), start["roles"].alias("roles"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("states"))
    every = reduce(DataFrame.unionByName, found) if found else none
    trace = every.groupBy("doc_id", "step").agg(F.max("states").alias("states"), F.max(F.when((F.col("states") > w.max_states) & (F.col("rank") == w.max_states), F.col("score"))).alias("cutoff"))
    out = {"trace": trace, "best": every.where("last and rank = 1").select("doc_id", "score", "roles", (F.col("pruned") | (F.col("states") > w.max_states)).alias("pruned"))}
    if watched is not None:
        on = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.step") == F.col("y.step")) & F.col("x.anchor").eqNullSafe(F.col("y.anchor")) & (F.col("x.total") == F.col("y.total"))
        out["ranks"] = watched.alias("x").join(every.alias("y"), on, "left").select("x.doc_id", "x.step", "x.anchor", "x.total", "y.rank")
    return out


SEARCHED = "doc_id long, step int, states long, cutoff double, score double, roles string, pruned boolean, ranks array<struct<anchor:bigint,total:bigint,rank:bigint>>"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("step", pa.int32()), ("states", pa.int64()), ("cutoff", pa.float64()), ("score", pa.float64()), ("roles", pa.string()), ("pruned", pa.bool_()),
    ("ranks", pa.list_(pa.struct([("anchor", pa.int64()), ("total", pa.int64()), ("rank", pa.int64())]))),
])
#: Rows that are gathered before they are searched.
GATHERED = 20_000


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole documents, in order, from batches sorted by doc_id."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table["doc_id"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def listed(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(where each list begins, {field: values of all lists}) of a column of lists of structs; null fields are 0, and their names with _null say which."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.asarray(lists.value_lengths().fill_null(0))
    flat, out = lists.flatten(), {}
    for field in flat.type:
        values = pa.compute.struct_field(flat, field.name)
        out[f"{field.name}_null"] = np.asarray(values.is_null())
        out[field.name] = np.asarray(values.fill_null(False if pa.types.is_boolean(field.type) else 0))
    return np.cumsum(counts) - counts, out


def parts(ids: np.ndarray, size: int) -> Iterator[slice]:
    """Slices of the rows of `size` documents each, of ids in order."""
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))[::size]
    for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
        yield slice(int(a), int(b))


def _search_batches(w: Weights, watching: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_documents(batches):
        for part in parts(table["doc_id"].to_numpy(), max(1, SIDE_BY_SIDE // w.max_states)):
            rows = table.slice(part.start, part.stop - part.start)
            ids, document = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
            begin, figures = listed(rows["figures"])
            watched = None
            if watching:
                first, states = listed(rows["watched"])
                line = np.repeat(np.arange(rows.num_rows), np.diff(np.append(first, len(states["total"]))))
                watched = line, states["anchor"], states["anchor_null"], states["total"]
            beams = Beams(document, begin, figures, w, watched)
            n = rows.num_rows
            states_of, cutoff = np.zeros(n, np.int64), np.full(n, np.nan)
            for step in beams.steps():
                states_of[step["line"]], cutoff[step["line"]] = step["states"], step["cutoff"]
            found, score, roles = beams.best()
            last = np.flatnonzero(np.append(document[1:] != document[:-1], True))
            text = np.frombuffer(LETTERS.encode(), np.uint8)[roles].tobytes().decode()
            ends = np.append(begin, len(roles))
            start = ends[beams.first_line]
            scores, pruned, written = [None] * n, [None] * n, [None] * n
            dropped = np.bincount(document, ~np.isnan(cutoff), beams.documents) > 0
            for d, at, points in zip(found.tolist(), last[found].tolist(), score.tolist(), strict=True):
                scores[at], pruned[at], written[at] = points, bool(dropped[d]), text[start[d] : ends[at + 1]]
            ranks: list | None = None
            if watching:
                ranks = [[] for _ in range(n)]
                for i, rank in enumerate(beams.watched_rank.tolist()):
                    if rank:
                        ranks[int(watched[0][i])].append({"anchor": None if watched[2][i] else int(watched[1][i]), "total": int(watched[3][i]), "rank": rank})
            yield pa.RecordBatch.from_arrays([
                rows["doc_id"].combine_chunks(), rows["step"].combine_chunks(), pa.array(states_of), pa.array(cutoff, mask=np.isnan(cutoff)), pa.array(scores, pa.float64()), pa.array(written, pa.string()), pa.array(pruned, pa.bool_()),
                pa.array(ranks if watching else [None] * n, ARROW.field("ranks").type),
            ], schema=ARROW)


def search_together(figures: DataFrame, w: Weights = Weights(), watched: DataFrame | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """What search() gives, in one pass and for narrow beams: documents are dealt out once, and a task searches some of them side by side (see beams.py). Nothing is saved on the way; a
    document's lines have to fit into a task."""
    columns = ["doc_id", F.col("step").cast("int").alias("step"), "figures"]
    lines = figures.select(*columns)
    if watched is not None:
        here = watched.groupBy("doc_id", F.col("step").cast("int").alias("step")).agg(F.collect_set(F.struct(F.col("anchor").cast("long").alias("anchor"), F.col("total").cast("long").alias("total"))).alias("watched"))
        lines = lines.join(here, ["doc_id", "step"], "left")
    tasks, watching = 4 * lines.sparkSession.sparkContext.defaultParallelism, watched is not None
    dealt = lines.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "step")
    found = settle(dealt.mapInArrow(lambda b: _search_batches(w, watching, b), SEARCHED))
    out = {"trace": found.select("doc_id", "step", "states", "cutoff"), "best": found.where("score is not null").select("doc_id", "score", "roles", "pruned")}
    if watched is not None:
        ranks = found.select("doc_id", "step", F.explode("ranks").alias("r")).select("doc_id", "step", "r.*")
        on = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.step") == F.col("y.step")) & F.col("x.anchor").eqNullSafe(F.col("y.anchor")) & (F.col("x.total") == F.col("y.total"))
        out["ranks"] = watched.alias("x").join(ranks.alias("y"), on, "left").select("x.doc_id", "x.step", "x.anchor", "x.total", "y.rank")
    return out


def chains(best: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, chain_no, opening_cents, closing_cents, score, amounts, constraints) as decode_documents() has them: the chains with a constraint of each document's best
    reading. What comes after a chain's last constraint belongs to none."""
    read = figures.select("doc_id", "step", F.transform("figures", lambda m: F.struct(F.col("line_no").alias("line_no"), m["value"].alias("value"), F.when(m["has_sign"] & (m["value"] < 0), -m["size"]).otherwise(m["size"]).alias("signed"), m["size"].alias("size"))).alias("m"))
    values = read.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("step", "m"))), lambda x: x["m"])).alias("m"))
    letters = F.filter(F.split("roles", ""), lambda c: c != "")
    each = best.join(values, "doc_id").select("doc_id", "score", F.posexplode(F.arrays_zip(letters.alias("role"), F.col("m").alias("m"))).alias("place", "z")).select("doc_id", "score", "place", "z.role", "z.m.*")
    in_order = Window.partitionBy("doc_id").orderBy("place")
    each = each.withColumn("opened", F.count_if(F.col("role") == "c").over(in_order))
    stands = F.col("role").isin("c", "a")
    before = F.last(F.when(stands, F.struct("line_no", "value")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    closed = F.max(F.when(F.col("role") == "a", F.col("place"))).over(Window.partitionBy("doc_id", "opened"))
    kept = each.withColumn("before", before).withColumn("closed", closed).where("opened > 0 and place <= closed")
    listed = lambda when, *c: F.sort_array(F.collect_list(F.when(when, F.struct(F.col("place").cast("long").alias("token"), *c))))
    found = kept.groupBy("doc_id", "score", "opened").agg(
        F.min_by("value", "place").alias("opening_cents"), F.max_by("value", F.when(F.col("role") == "a", F.col("place"))).alias("closing_cents"),
        listed(F.col("role").isin("+", "-"), F.when(F.col("role") == "-", -F.col("size")).otherwise(F.col("signed")).alias("cents"), F.col("line_no")).alias("amounts"),
        listed(F.col("role") == "a", F.col("before.line_no").alias("from_line"), F.col("line_no").alias("to_line"), F.col("before.value").alias("from_cents"), F.col("value").alias("to_cents"), F.lit(True).alias("passed")).alias("constraints"),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("opened")) - 1
    return found.select("doc_id", number.alias("chain_no"), "opening_cents", "closing_cents", "score", "amounts", "constraints")
