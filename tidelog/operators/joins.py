"""Joins on order: the latest earlier row, and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    """Every row of left with columns of the last row of right that has the same keys and a time not after its own; null without one.

    One union and one sort by (keys, time) instead of a join by inequality. Of rows of right at one time the largest by columns
    counts. A null key matches no row, a null time none either.
    """
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    l = left.select(F.struct(*left.columns).alias("_l"), *keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    r = right.where(ok & F.col(time).isNotNull()).select(F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), *keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_r"))
    w = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    found = F.when(ok & F.col("_t").isNotNull(), F.col("_m"))
    return both.select("_l.*", *[found[c].alias(c if c not in left.columns else f"right_{c}") for c in columns])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], *, width: int) -> DataFrame:
    """Pairs of left (keys, begin, end, ...) and right (keys, begin, end, ...) whose intervals, both ends included, overlap: right's other
    columns get the prefix right_.

    Intervals are dealt to cells of ``width``; a pair meets in the cell where the later one begins, so it comes once. width should
    be about the length of an interval.
    """
    cells = F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width)))
    l = left.withColumn("_cell", cells)
    r = right.withColumn("_cell", cells).select(*keys, "_cell", *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys])
    both = l.join(r, [*keys, "_cell"]).where((F.col("begin") <= F.col("right_end")) & (F.col("right_begin") <= F.col("end")))
    return both.where(F.col("_cell") == F.floor(F.greatest("begin", "right_begin") / width)).drop("_cell")
