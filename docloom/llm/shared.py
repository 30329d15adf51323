"""Materialisation and connected components for the multi-stage operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


#: Folders of the scratch() blocks that are open, innermost last.
_scratch: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside the block go at its end; results must be written by then."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.remove(folder)
        _delete(spark, folder)


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back: its lineage is cut, and a lost executor costs no more than a read.

    The table goes with the innermost scratch() block; outside of one it stays until the folder is cleared.
    """
    path = f"{_scratch[-1] if _scratch else shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the least node of its component.

    Large-star and small-star steps in turn (Kiveris and others, 2014); every step is an aggregation with partial sums and an
    equi-join, so a node with very many neighbours is never gathered into one task. Steps end as soon as the edges are stars,
    which one count by node tells; edges that are stars from the start take no step.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mine = both.filter("b < a") if small else both
        least = mine.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = mine.join(least, "a")
        if small:
            out = joined.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        else:
            out = joined.filter("b > a").select(F.col("b").alias("x"), "m")
        out = out.filter("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b"))
        return out.distinct() if small else out

    def settled(e: DataFrame) -> bool:
        """Whether every node is either a root or hangs on one root; a < b in every edge, so that root is its least node."""
        ends = e.select(F.col("b").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("a").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")
        return open_ends.agg(F.count("*")).first()[0] == 0

    now = materialise(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(most):
        if settled(now):
            break
        now = materialise(spark, star(star(now, False), True))
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node").unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def sampled(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most most rows of each group, those with the least hash of key: a bounded sample that doesn't depend on the partitioning.

    Rows are thinned by a hash bound that follows the group's size first, so the ranking of a group sees about twice most rows however many it has.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.join(F.broadcast(sizes), group).filter(share * F.col("_n") <= 2 * most + 100).withColumn("_s", share)
    order = Window.partitionBy(group).orderBy("_s", F.xxhash64(key), key)
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_n", "_s", "_r")
