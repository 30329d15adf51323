"""Running totals over long runs, and joins of points with intervals, without gathering a run or a document into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Width of the finest bins of intervals, how much wider each level is, and how many levels there are: 64 x 16**11 characters are more than any document has.
WIDTH, FACTOR, LEVELS = 64, 16, 12


def in_ranges(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows, written, with _range: rows lie in ranges of (key, order), so one long run is spread over many; rows of equal order share theirs."""
    return written(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))


def with_ranges(rows: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """rows(key, _range, ...) with the columns of told(_key, _r, ...), one row a key and range."""
    return rows.join(told, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r"))).drop("_key", "_r")


def before(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with name: the sum of value (nulls are 0) over the rows in front of each, in its run.

    Rows of equal order stand in any order. Each range is summed by itself; its sum, one row, goes to the ranges behind it.
    """
    ranged = in_ranges(rows.withColumn("_v", F.coalesce(value, F.lit(0)).cast("long")), key, order)
    told = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.sum("_v").alias("n"))
    carried = F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = with_ranges(ranged.withColumn("_own", own), told.select("_key", "_r", carried.alias("_carried")), key)
    return out.withColumn(name, F.col("_own") + F.col("_carried")).select(*rows.columns, name)


def _width(level: Column) -> Column:
    return F.pow(F.lit(float(FACTOR)), level).cast("long") * WIDTH


def located(points: DataFrame, intervals: DataFrame, key: str, position: str = "position", start: str = "start", end: str = "end", closed: bool = False) -> DataFrame:
    """points(key, position, ...) with each interval(key, start, end, ...) of the key that holds the position: start <= position < end, or <= end if closed.

    An interval lies in the level whose bins are as wide as it is, so it touches two bins at most, and a point meets one bin of every level in use: an
    equi-join on (key, level, bin), however long or many the intervals of a key are. Empty intervals hold nothing unless closed; null keys and ends meet nothing; columns of
    both sides stay, so they must differ but for the key.
    """
    last = F.col(end) if closed else F.col(end) - 1
    sound = intervals.filter((F.col(start) >= 0) & (last >= F.col(start)))
    level = F.lit(0)
    for n in range(LEVELS - 1):
        level = F.when(last - F.col(start) >= WIDTH * FACTOR**n, n + 1).otherwise(level)
    binned = sound.withColumn("_level", level).withColumn("_a", F.floor(F.col(start) / _width(F.col("_level")))).withColumn("_b", F.floor(last / _width(F.col("_level"))))
    binned = binned.withColumn("_bin", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    used = sorted(r[0] for r in binned.select("_level").distinct().collect())  # at most LEVELS
    levels = F.array(*[F.lit(n) for n in used]) if used else F.array().cast("array<int>")
    asked = points.withColumn("_level", F.explode(levels)).withColumn("_bin", F.floor(F.col(position) / _width(F.col("_level"))))
    holds = (F.col(start) <= F.col(position)) & (F.col(position) <= last)
    return asked.join(binned, [key, "_level", "_bin"]).filter(holds).drop("_level", "_bin")
