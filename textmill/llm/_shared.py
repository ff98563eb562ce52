"""Helpers of this subpackage that touch the session: the shared folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.session import ship

#: The word rule of all operators here.
WORD = r"[^\x20\x09-\x0D]+"
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ready(spark: SparkSession) -> None:
    """Sends this package to the workers once. Long texts are no trouble: Spark bounds the bytes of an Arrow batch, chunks() those at work."""
    ship(spark)


def written(df: DataFrame, spark: SparkSession | None = None, release: bool = False) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, any executor can read it again, and it survives lost executors.

    release: Spark deletes the shuffle files of this write when it ends, not when the driver next collects garbage.
    """
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/textmill/{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._textmill_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._textmill_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows, written, with their place (from 0) in a total order as a long: ranges are numbered apart, and only the sizes of
    the ranges, one number per shuffle partition, go to the driver."""
    spark = rows.sparkSession
    part, place = fresh(rows, "part"), fresh(rows, name)
    cut = written(rows.repartitionByRange(partitions(spark), *order).withColumn(part, F.spark_partition_id()))
    sizes = dict(cut.groupBy(part).count().collect())
    before, starts = 0, []
    for k in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    start = F.element_at(F.array(*(F.lit(x).cast("long") for x in starts or [0])), F.col(part) + 1)
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return cut.withColumn(place, start + inside - 1).drop(part)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def words_count(text: Column) -> Column:
    """Words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over (src, dst), for every id in an edge.

    By contraction: each round every id moves to the one of itself and its neighbours with the smallest hash, edges follow their
    ends, and those inside one place are gone. Hashes stand for random priorities, so a fraction of the ids goes each
    round whatever the shape, and few edges outlive the first. The moves are then followed from the last back to the first.
    """
    spark = edges.sparkSession
    left = written(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    moves: list[DataFrame] = []
    while not left.isEmpty():
        if len(moves) == rounds:
            raise RuntimeError("components did not settle")
        near = left.select(F.col("src").alias("id"), order("dst").alias("to")).unionByName(left.select(F.col("dst").alias("id"), order("src").alias("to")))
        move = written(near.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least(order("id"), "to")["id"].alias("to")))
        moves.append(move)
        follow = left.join(move.select(F.col("id").alias("src"), F.col("to").alias("a")), "src").join(move.select(F.col("id").alias("dst"), F.col("to").alias("b")), "dst")
        nxt = written(follow.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        dropped(spark, left)
        left = nxt
    dropped(spark, left)
    if not moves:
        out = written(edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0))
        return out
    place = moves[-1]
    for move in reversed(moves[:-1]):
        place = move.join(place.select(F.col("id").alias("to"), F.col("to").alias("last")), "to", "left").select("id", F.coalesce("last", "to").alias("to"))
    placed = written(place)
    dropped(spark, *moves)
    least = placed.groupBy("to").agg(F.min("id").alias("low"))
    out = written(placed.join(least, "to").select("id", F.least("low", "to").alias("component")))
    dropped(spark, placed)
    return out
