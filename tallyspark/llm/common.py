"""What the corpus operators share: words as expressions, shared scratch folders, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java class of the blanks between words; a word is a maximal run of anything else.
BLANK = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def words(text: Column) -> Column:
    """The words of a text in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever its own are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the session's checkpoint folder. Where none is set, a local session takes a
    temporary folder and a cluster one below its warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-"))
        else:
            sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, which hands rows to Python in batches of at most BATCH_BYTES, whatever the length of texts. A smaller
    bound stays as it is. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


class Scratch:
    """Tables below the shared folder, deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """df, computed once and read back from Parquet: its lineage ends here, and its size is known to the planner."""
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a checkpoint, which outlives the block. Its files go with the last reference to it if the context was
        started with spark.cleaner.referenceTracking.cleanCheckpoints, as by tallyspark.session.session()."""
        return df.checkpoint(eager=True)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def drop(self) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    s = Scratch(spark)
    try:
        yield s
    finally:
        s.drop()


#: A saved table of so many bytes, by width(), may be broadcast.
BROADCAST_BYTES = 2 << 20


def width(df: DataFrame) -> Column:
    """Bytes of a row, about: what its strings and arrays hold, and 8 for each other value."""

    def of(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(column).cast("long"), F.lit(0)) + 16
        if isinstance(kind, T.StructType):
            return sum((of(column[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
        if isinstance(kind, T.ArrayType):
            each = F.transform(column, lambda x: of(x, kind.elementType).cast("long"))
            return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)) + 24
        return F.lit(8).cast("long")

    return sum((of(F.col(quoted(f.name)), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))


def small(df: DataFrame) -> bool:
    """Whether a saved table is small enough to be broadcast. The measure is a sum over all its rows."""
    return (df.agg(F.sum(width(df))).first()[0] or 0) <= BROADCAST_BYTES


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """left join right, with right, a saved table, broadcast only if it was measured to be small. Otherwise Spark deals out
    both sides by key and AQE splits the partitions that are too large."""
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def components(s: Scratch, edges: DataFrame, most: int = 40) -> DataFrame:
    """edges(a, b: long) -> (node, component): each node that has an edge, with the smallest node it can reach.

    Alternates large-star and small-star steps until the edges stay as they are. Everything is a join or a
    minimum by key over narrow rows; the driver sees only a count and a checksum.
    """
    e = s.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = s.save(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components did not settle within {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
