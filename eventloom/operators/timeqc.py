"""Acquisition-time quality control: segments, equal-count bins, robust scores of bins, intervals and masks.

A sample's events are ordered by event_index, and order decides segments. It is a prefix scan of two levels: windows run over
blocks of event_index; what a block carries to the next (its last time, segments opened, wraps and the latest time since the last
opening) is combined over a sample's blocks, a row each, and then applied. No window holds a sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_finite, robust_z, safe_divide
from .ranking import indexed

#: Fixed values.
BACKWARD = 1e-6
WRAP_FROM, WRAP_TO = 0.8, 0.2
CONSISTENT = 1.4826


def segments(events: DataFrame, by: str, index: str, time: str, timer_range: float, *, block: int = 1 << 18, blocks: bool = False) -> DataFrame:
    """events with segment (0-based; null for invalid times) and unwrapped time. Time going back opens a segment, unless it goes
    from above 0.8 to below 0.2 of the timer's range, which is a wrap; so does the first valid time after an invalid one. Blocks
    are of `block` consecutive indexes; with `blocks` the result keeps them as _block, which bins can use."""
    order, t = Window.partitionBy(by, "_block").orderBy(index), F.col("_t")

    def steps(before: Column, now: Column) -> tuple[Column, Column]:
        """(whether a segment opens, whether the timer wraps) between two neighbours."""
        back = F.coalesce(now < before - BACKWARD, F.lit(False))
        wrap = back & (before > WRAP_FROM * timer_range) & (now < WRAP_TO * timer_range)
        return (now.isNotNull() & (before.isNull() | (back & ~wrap))).cast("int"), wrap.cast("int")

    rows = events.withColumns({"_block": F.floor(F.col(index) / block), "_t": F.when(is_finite(F.col(time)) & (F.col(time) >= 0), F.col(time))})
    rows = rows.withColumns({"_p": F.lag("_t").over(order), "_k": F.row_number().over(order)})
    new, wrap = (F.when(F.col("_k") > 1, x).otherwise(0) for x in steps(F.col("_p"), t))  # a block's first event waits for the block before
    rows = rows.withColumns({"_new": new, "_wrap": wrap}).withColumn("_s", F.sum("_new").over(order))
    inside = Window.partitionBy(by, "_block", "_s").orderBy(index)
    rows = rows.withColumn("_w", F.sum(F.when(F.col("_new") == 1, 0).otherwise(F.col("_wrap"))).over(inside)).withColumn("_m", F.max(t + timer_range * F.col("_w")).over(inside))

    last = F.struct("_s", "_w", "_m", "_t")
    each = rows.groupBy(by, "_block").agg(F.min_by(F.struct("_t"), index)["_t"].alias("_first"), F.max_by(last, index).alias("_end"))
    along = Window.partitionBy(by).orderBy("_block")
    opens, wraps = steps(F.lag("_end._t").over(along), F.col("_first"))
    each = each.withColumns({"_opens": opens, "_wraps": F.when(opens == 1, 0).otherwise(wraps)}).withColumn("_breaks", (F.col("_opens") + F.col("_end._s") > 0).cast("int"))
    # blocks since the last one in which a segment opens share its wraps and its latest time
    each = each.withColumns({"_before": F.coalesce(F.sum(F.col("_opens") + F.col("_end._s")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_open": F.sum("_breaks").over(along)})
    since = Window.partitionBy(by, "_open").orderBy("_block")
    own = F.col("_end._w") + F.when(F.col("_end._s") > 0, 0).otherwise(F.col("_wraps"))
    each = each.withColumn("_upto", F.sum(own).over(since)).withColumn("_shift", F.when(F.col("_end._s") > 0, 0).when(F.col("_opens") == 1, 0).otherwise(F.col("_upto") - F.col("_end._w")))
    each = each.withColumn("_latest", F.max(F.col("_end._m") + timer_range * F.col("_shift")).over(since))
    carry = each.select(
        by, "_block", (F.col("_before") + F.col("_opens")).alias("_seen"),
        F.when(F.col("_opens") == 1, 0).otherwise(F.coalesce(F.lag("_upto").over(along), F.lit(0)) + F.col("_wraps")).alias("_turns"),
        F.when(F.col("_opens") == 0, F.lag("_latest").over(along)).alias("_most"),
    )

    segment = F.when(t.isNotNull(), F.col("_seen") + F.col("_s") - 1)
    unwrapped = F.when(F.col("_s") > 0, F.col("_m")).otherwise(F.greatest(F.col("_most"), F.col("_m") + timer_range * F.col("_turns")))
    out = rows.join(carry, [by, "_block"]).withColumns({"segment": segment, "unwrapped": F.when(t.isNotNull(), unwrapped)})
    out = out.drop("_t", "_p", "_k", "_new", "_wrap", "_s", "_w", "_m", "_seen", "_turns", "_most")
    return out if blocks else out.drop("_block")


def _ranked(events: DataFrame, by: str, index: str, mask: Column | None) -> DataFrame:
    """Events of a segment (and of the mask, if there is one) with their rank _r and the number _n of such events of it."""
    good = events.where(F.col("segment").isNotNull() if mask is None else F.col("segment").isNotNull() & mask)
    return indexed(good, [by, "segment"], index, "_r", 1 << 18, cut="_block" if "_block" in events.columns else None, total="_n").drop("_block")


def equal_count_bins(events: DataFrame, by: str, index: str, target: int = 500, *, mask: Column | None = None) -> DataFrame:
    """Valid events (of the mask, if there is one) with bin: each segment in max(1, round(n / target)) bins of sizes that differ
    by one at most."""
    bins = F.greatest(F.lit(1), F.floor(F.col("_n") / target + 0.5))
    n = _ranked(events, by, index, mask).withColumn("_bins", bins)
    return n.withColumn("bin", F.floor(((F.col("_r") + 1) * F.col("_bins") - 1) / F.col("_n"))).drop("_n", "_r", "_bins")


def overlapping_bins(events: DataFrame, by: str, index: str, size: int, overlap: float = 0.5, *, mask: Column | None = None) -> DataFrame:
    """Valid events, once for each bin that they are in: bins of `size` events at steps of round(size * (1 - overlap)); a last
    bin of under half the size joins the one before."""
    step = max(1, int(size * (1 - overlap) + 0.5))
    n = _ranked(events, by, index, mask)
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step))
    short = (last > 0) & (F.col("_n") - last * step < max(1, size // 2))
    top = F.when(short, last - 1).otherwise(last)
    first = F.greatest(F.lit(0), F.floor((F.col("_r") - size) / step) + 1)
    return n.withColumns({"_a": F.least(first, top), "_b": F.least(F.floor(F.col("_r") / step), top)}).withColumn("bin", F.explode(F.sequence("_a", "_b"))).drop("_n", "_r", "_a", "_b")


def bin_summary(binned: DataFrame, by: str, index: str, time: str, channels: Sequence[str]) -> DataFrame:
    """(by, segment, bin, n, first, last, rate, and <channel>_median and <channel>_iqr): rate is (n - 1) over the time spanned;
    null where that is not above zero. Bins hold a bounded number of events."""
    one = [F.count(F.lit(1)).alias("n"), F.min(index).alias("first"), F.max(index).alias("last"), F.min_by(time, index).alias("_a"), F.max_by(time, index).alias("_b")]
    for c in channels:
        x = F.when(is_finite(F.col(c)), F.col(c))
        one.append(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{c}"))
    out = binned.groupBy(by, "segment", "bin").agg(*one)
    rate = safe_divide(F.col("n") - 1, F.col("_b") - F.col("_a"))
    picked = [x for c in channels for x in (F.col(f"_{c}")[1].alias(f"{c}_median"), (F.col(f"_{c}")[2] - F.col(f"_{c}")[0]).alias(f"{c}_iqr"))]
    return out.select(by, "segment", "bin", "n", "first", "last", F.when(rate > 0, rate).alias("rate"), *picked)


def metric_baselines(bins: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """(by, metric, median, scale): over a sample's bins, scale is 1.4826 times the median distance from the median."""
    long = bins.select(by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))).where(is_finite(F.col("x")))
    centre = long.groupBy(by, "metric").agg(F.percentile("x", F.lit(0.5)).alias("median"))  # a bin is hundreds of events
    away = long.join(centre, [by, "metric"]).groupBy(by, "metric", "median").agg(F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5)).alias("mad"))
    return away.select(by, "metric", "median", (CONSISTENT * F.col("mad")).alias("scale"))


def flagged_bins(bins: DataFrame, by: str, metrics: Sequence[str], limit: float = 4.0, least_bins: int = 3) -> DataFrame:
    """bins with reasons (metrics whose robust z is over limit, sorted) and flagged. Samples of fewer bins are not flagged."""
    long = bins.select(by, "segment", "bin", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])))
    z = long.join(metric_baselines(bins, by, metrics), [by, "metric"]).where(is_finite(F.col("x")))
    over = z.where(F.abs(robust_z(F.col("x"), F.col("median"), F.col("scale"))) > limit).groupBy(by, "segment", "bin").agg(F.array_sort(F.collect_set("metric")).alias("reasons"))
    enough = bins.groupBy(by).agg((F.count(F.lit(1)) >= least_bins).alias("_enough"))
    found = bins.join(over, [by, "segment", "bin"], "left").join(enough, by)
    reasons = F.when(F.col("_enough"), F.coalesce("reasons", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return found.withColumn("reasons", reasons).withColumn("flagged", F.size("reasons") > 0).drop("_enough")


def intervals(bins: DataFrame, by: str, flag: Column) -> DataFrame:
    """(by, segment, first_bin, last_bin, first, last, reasons): runs of flagged neighbouring bins of a segment."""
    run = bins.where(flag).withColumn("_island", F.col("bin") - F.row_number().over(Window.partitionBy(by, "segment").orderBy("bin")))
    return run.groupBy(by, "segment", "_island").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons")).drop("_island")


def retained(binned: DataFrame, flagged: DataFrame, by: str) -> DataFrame:
    """binned with time_ok: whether the event's bin is not flagged."""
    bad = flagged.where("flagged").select(by, "segment", "bin", F.lit(True).alias("_bad"))
    return binned.join(bad, [by, "segment", "bin"], "left").withColumn("time_ok", F.col("_bad").isNull()).drop("_bad")


def without_short_runs(bins: DataFrame, by: str, good: str, least: int = 5) -> DataFrame:
    """bins with kept: good bins, but for runs of fewer than `least` that touch neither end of the sample's bins."""
    w = Window.partitionBy(by).orderBy("bin")
    island = bins.withColumn("_island", F.when(F.col(good), F.col("bin") - F.sum(F.col(good).cast("int")).over(w)))
    run = Window.partitionBy(by, "_island")
    ends = Window.partitionBy(by)
    edge = (F.min("bin").over(run) == F.min("bin").over(ends)) | (F.max("bin").over(run) == F.max("bin").over(ends))
    return island.withColumn("kept", F.col(good) & ((F.count(F.lit(1)).over(run) >= least) | edge)).drop("_island")


def longest_run(bins: DataFrame, by: str, flag: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy("bin")
    island = bins.where(F.col(flag)).withColumn("_island", F.col("bin") - F.row_number().over(w))
    lengths = island.groupBy(by, "_island").agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.max("n").alias("longest"))
    return bins.select(by).distinct().join(lengths, by, "left").select(by, F.coalesce("longest", F.lit(0)).alias("longest"))


def moving_mean(bins: DataFrame, by: str, value: str, reach: int = 2) -> DataFrame:
    """bins with smooth: the mean of finite values within `reach` bins."""
    x = F.when(is_finite(F.col(value)), F.col(value))
    return bins.withColumn("smooth", F.avg(x).over(Window.partitionBy(by).orderBy("bin").rowsBetween(-reach, reach)))
