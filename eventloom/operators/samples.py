"""Per-sample statistics, histograms and filter funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from .beside import beside
from .ranking import quantiles


def channel_stats(events: DataFrame, by: str, channels: Sequence[str]) -> DataFrame:
    """(by, channel, n, mean, sd, min, max, median): of finite values from zero up the count, mean, population deviance, ends and
    exact median, all channels in the same passes. A sample without such values has n 0 and nulls."""
    melted = F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("_x")) for c in channels]))
    good = events.select(by, *[F.when(is_finite(F.col(c)) & (F.col(c) >= 0), F.col(c)).alias(c) for c in channels])
    moments = good.select(by, melted).groupBy(by, "channel").agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("sd"), F.min("_x").alias("min"), F.max("_x").alias("max"))
    middle = quantiles(good, by, list(channels), [0.5]).select(by, F.col("column").alias("channel"), F.col("q").alias("median"))
    return moments.join(middle, [by, "channel"], "left")


def column_stats(events: DataFrame, by: str, value: str) -> DataFrame:
    """channel_stats() of one channel."""
    return channel_stats(events, by, [value]).drop("channel")


def spread(events: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median, mad, robust_sd) of finite values: the median of distances from the median, and 1.4826 times it."""
    centre = quantiles(events, by, value, [0.5]).select(by, F.col("q").alias("median"))
    away = beside(events, centre, by, [value]).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = quantiles(away, by, "_d", [0.5]).select(by, F.col("q").alias("mad"))
    return centre.join(mad, by).withColumn("robust_sd", 1.4826 * F.col("mad"))


def structural_mask(channels: dict[str, Column | float | None]) -> Column:
    """Every present channel finite, from zero up, and below its ceiling if it has one: a number, or a column, null for none."""
    ok = F.lit(True)
    for name, ceiling in channels.items():
        x = F.col(name)
        one = is_finite(x) & (x >= 0)
        if ceiling is not None:
            one = one & F.coalesce(x < ceiling, F.lit(True))
        ok = ok & one
    return F.coalesce(ok, F.lit(False))


def rejection_class(x: Column, retained: Column, ceiling) -> Column:
    """Why an event doesn't count for the histogram, in order; null: it counts."""
    return F.when(~retained, "not_retained").when(~is_finite(x), "nonfinite").when(x < 0, "negative").when(x >= ceiling, "saturated")


def combined(*masks: Column) -> Column:
    """The conjunction of masks; a null mask is a filter that was not applied."""
    out = F.lit(True)
    for m in masks:
        out = out & F.coalesce(m, F.lit(True))
    return out


def funnel(events: DataFrame, by: str, masks: dict[str, Column]) -> DataFrame:
    """(by, step, name, entered, lost) in one pass: what each filter loses of what the ones before it kept."""
    kept, sums = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for k, m in enumerate(masks.values(), 1):
        kept = kept & F.coalesce(m, F.lit(True))
        sums.append(F.count_if(kept).alias(f"_{k}"))
    counts = events.groupBy(by).agg(*sums)
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.col(f"_{k - 1}").alias("entered"), (F.col(f"_{k - 1}") - F.col(f"_{k}")).alias("lost")) for k, n in enumerate(masks, 1)])
    return counts.select(by, F.inline(steps))


def resolved_range(low: Column, high: Column) -> tuple[Column, Column]:
    """A range of no width is widened about its value."""
    pad = F.greatest(F.abs(low) * 1e-6, F.lit(1.0)) / 2
    return F.when(high > low, low).otherwise(low - pad), F.when(high > low, high).otherwise(high + pad)


def histogram(events: DataFrame, by: str, value: str, bins: int, *, low: float | None = None, high: float | None = None, shared: bool = False, log: bool = False) -> DataFrame:
    """(by, bin, count, left, right) of finite values, empty bins included. Without low and high the range is each sample's, or
    with `shared` the cohort's. The largest value falls in the last bin; values outside a given range are left out. log: bins
    are equal in log10, of positive values."""
    x = F.log10(F.col(value)) if log else F.col(value)
    usable = events.where(is_finite(F.col(value)) & (F.col(value) > 0 if log else F.lit(True))).select(by, x.alias("_x"))
    if low is None:
        ends = usable.agg(F.min("_x").alias("_a"), F.max("_x").alias("_b")) if shared else usable.groupBy(by).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        if shared:
            ends = usable.select(by).distinct().crossJoin(F.broadcast(ends))  # one row
    else:
        ends = usable.select(by).distinct().withColumns({"_a": F.lit(float(low)), "_b": F.lit(float(high))})
    a, b = resolved_range(F.col("_a"), F.col("_b"))
    ends = ends.select(by, a.alias("_a"), b.alias("_b")).withColumn("_w", (F.col("_b") - F.col("_a")) / bins)
    put = beside(usable, ends, by, ["_x"]).where((F.col("_x") >= F.col("_a")) & (F.col("_x") <= F.col("_b")))
    counts = put.groupBy(by, F.least(F.floor((F.col("_x") - F.col("_a")) / F.col("_w")), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select(by, "_a", "_w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counts, [by, "bin"], "left").select(by, "bin", F.coalesce("count", F.lit(0)).alias("count"), (F.col("_a") + F.col("bin") * F.col("_w")).alias("left"), (F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("right"))


def clipping(events: DataFrame, by: str, value: str, low: float, high: float) -> DataFrame:
    x = F.col(value)
    return events.where(is_finite(x)).groupBy(by).agg(F.count_if(x < low).alias("underflow"), F.count_if(x > high).alias("overflow"), F.count_if((x >= low) & (x <= high)).alias("in_range"))


def recommended_bins(counts: DataFrame, n: str = "n", stops: Sequence[int] = (128, 256, 512, 1024)) -> DataFrame:
    """One row, bins: the largest stop over the smallest that leaves 50 events a bin in the smallest sample, else the smallest;
    256 if nothing is known."""
    worst = counts.agg(F.min(n).alias("worst"))
    bins = F.lit(stops[0])
    for s in stops[1:]:
        bins = F.when(F.col("worst") >= 50 * s, s).otherwise(bins)
    return worst.select("worst", F.when(F.col("worst").isNull(), 256).otherwise(bins).alias("bins"))


def covariance(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, mean_x, mean_y, xx, xy, yy, angle): population covariance and the principal axis in radians."""
    good = points.where(is_finite(F.col(x)) & is_finite(F.col(y)))
    sums = good.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.var_pop(y).alias("yy"))
    return sums.withColumn("angle", 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")))


def stats_wide(stats: DataFrame, by: str, channel: str, metrics: Sequence[str]) -> DataFrame:
    """A column channel:metric for each channel and metric, a row per sample."""
    names = [r[0] for r in stats.select(channel).distinct().orderBy(channel).limit(1025).collect()]
    if len(names) > 1024:
        raise ValueError("over 1024 channels")
    picks = [F.max(F.when(F.col(channel) == n, F.col(m))).alias(f"{n}:{m}") for n in names for m in metrics]
    return stats.groupBy(by).agg(*picks)
