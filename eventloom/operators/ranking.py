"""Ranks and exact quantiles of groups that may be too large for one task.

A window over a sample sorts it in one task. Here a sample's rows are cut into blocks of the ordering key; counts per block give
each block's offset, and only blocks are sorted. Quantiles are bracketed by rank first, and only what lies in a bracket is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from .beside import beside


def indexed(df: DataFrame, by: str | Sequence[str], order: str, name: str, block: int = 1 << 20, *, cut: str | None = None, total: str | None = None) -> DataFrame:
    """df with `name`: the 0-based rank of the integer column `order`, unique within `by`; with `total` also the number of rows
    of the group. Rows are sorted in blocks of `block` consecutive keys, or of the column `cut`, which must not fall as the order
    rises."""
    keys = [by] if isinstance(by, str) else list(by)
    rows = df.withColumn("_cut", F.col(cut) if cut else F.floor(F.col(order) / block))
    group = Window.partitionBy(*keys)
    counts = rows.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumns({"_before": F.sum("_n").over(group.orderBy("_cut")) - F.col("_n"), "_total": F.sum("_n").over(group)})
    rank = F.row_number().over(Window.partitionBy(*keys, "_cut").orderBy(order)) - 1
    placed = rows.withColumn("_rank", rank).join(before.drop("_n"), [*keys, "_cut"]).withColumn(name, F.col("_before") + F.col("_rank"))
    return (placed.withColumn(total, F.col("_total")) if total else placed).drop("_cut", "_rank", "_before", "_total")


def _wanted(shares: Sequence[float], nearest_rank: bool) -> Column:
    """array<struct<p, at, weight>> of the 0-based ranks whose weighted sum is the quantile p of _total values."""
    out = []
    for p in shares:
        place = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        one = lambda at, weight, p=p: F.struct(F.lit(float(p)).alias("p"), at.cast("long").alias("at"), weight.cast("double").alias("weight"))
        if nearest_rank:
            out.append(one(F.floor(place + 0.5), F.lit(1.0)))
        else:
            out += [one(low, F.when(low == high, 1.0).otherwise(high - place)), F.when(low < high, one(high, place - low))]
    return F.array_compact(F.array(*out))


def quantiles(df: DataFrame, by: str, value: str | Sequence[str], shares: Sequence[float], *, nearest_rank: bool = False, accuracy: int = 10_000) -> DataFrame:
    """(by, p, q): exact quantiles of the finite values of each group, by linear interpolation of (n - 1) p, or the value at the
    rank nearest to it. Of several columns (by, column, p, q), all in the same two passes.

    The first pass brackets every share by a mergeable sketch of ranks, 3 / accuracy to either side where the sketch is right
    within 1 / accuracy; a group of up to `accuracy` values is one bracket. The second counts the values of brackets one by one,
    equal ones together and before the shuffle, and all others between two brackets as one number. Brackets follow ranks, so
    neither a far value nor many equal ones widen them: of n values some 6 n / accuracy a share are sorted. A rank outside its
    bracket would be an error, not a wrong result.
    """
    columns, shares = [value] if isinstance(value, str) else list(value), sorted(set(shares))
    keys, wide = [by, "_column"], 3.0 / accuracy
    melted = F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in columns]))
    values = df.select(by, melted).where(is_finite(F.col("_x")))
    ends = [x for p in shares for x in (max(0.0, p - wide), min(1.0, p + wide))]
    sketch = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", ends, accuracy).alias("_e"))
    small = F.col("_n") <= accuracy
    low = [F.when(small, float("-inf")).otherwise(F.col("_e")[2 * k]).alias(f"_a{k}") for k in range(len(shares))]
    high = [F.when(small, float("inf")).otherwise(F.col("_e")[2 * k + 1]).alias(f"_b{k}") for k in range(len(shares))]
    placed = beside(values, sketch.select(*keys, *low, *high), keys, ["_x"])
    x, cell, inside = F.col("_x"), F.lit(0), F.lit(False)
    for k in range(len(shares)):
        cell = cell + (x >= F.col(f"_a{k}")).cast("int")
        inside = inside | ((x >= F.col(f"_a{k}")) & (x <= F.col(f"_b{k}")))
    # in a cell the values outside brackets are greater than those inside
    counts = placed.groupBy(*keys, cell.alias("_cell"), F.when(inside, x).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy("_cell", F.asc_nulls_last("_x"))), "_total": F.sum("_n").over(group)})
    hits = F.filter(_wanted(shares, nearest_rank), lambda w: (w["at"] < F.col("_upto")) & (w["at"] >= F.col("_upto") - F.col("_n")))
    found = upto.select(by, "_column", "_x", hits.alias("_w")).where(F.size("_w") > 0).select(by, "_column", "_x", F.inline("_w"))
    sure = F.when(F.col("_x").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(F.col("_x"))
    out = found.groupBy(by, "_column", "p").agg(F.sum(sure * F.col("weight")).alias("q"))
    return out.select(by, "p", "q") if isinstance(value, str) else out.select(by, F.col("_column").alias("column"), "p", "q")
