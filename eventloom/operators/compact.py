"""Grouped fits over compacted inputs: events of a sample become a grid of cells with counts before any of them meets Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from .beside import beside


def cells(points: DataFrame, by: str, x: str, y: str, grid: int = 256) -> DataFrame:
    """(by, cells: array of (x, y, n)): the mean point and count of each occupied cell of a grid over each sample's range. At
    most grid * grid cells a sample, whatever its events; partial sums do the work before the shuffle."""
    good = points.where(is_finite(F.col(x)) & is_finite(F.col(y))).select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = good.groupBy(by).agg(*[f(c).alias(n) for c, n in (("x", "x0"), ("y", "y0")) for f in (F.min,)], F.max("x").alias("x1"), F.max("y").alias("y1"))
    at = lambda c: F.when(F.col(f"{c}1") > F.col(f"{c}0"), F.least(F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * grid), F.lit(grid - 1))).otherwise(0)
    counted = beside(good, ends, by, ["x", "y"]).groupBy(by, at("x").alias("i"), at("y").alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    return counted.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("x", "y", "n"))).alias("cells"))
