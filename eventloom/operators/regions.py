"""Regions of peaks on histograms: smoothing, level crossings, proposals and local estimates, as joins and aggregates over bins.

bins(by, bin, left, right, y): consecutive bins from 0 with their edges. A sample has a thousand of them or so, and few peaks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp

#: Reach of a proposed region in standard deviations, outwards and towards the other peak, and in bins at least;
#: the width that stands for an unknown one, as a share of the peak's centre.
OUTER, INNER, LEAST_BINS, DEFAULT_CV = 2.75, 1.5, 1.5, 0.06
TINY = 1e-12


def smoothed(bins: DataFrame, by: str, y: str = "y", sigma: float = 2.0) -> DataFrame:
    """bins with smooth: the mean of the bins within 4 sigma, weighted by a Gaussian of the distance; fewer bins at the ends."""
    if not (sigma > 0 and math.isfinite(sigma)):
        return bins.withColumn("smooth", F.col(y).cast("double"))
    reach = max(1, math.ceil(4 * sigma))
    near = F.collect_list(F.struct("bin", F.col(y).cast("double").alias("y"))).over(Window.partitionBy(by).orderBy("bin").rowsBetween(-reach, reach))
    rows = bins.withColumn("_near", near)
    weight = lambda v: F.exp(-0.5 * F.pow((v["bin"] - F.col("bin")) / F.lit(float(sigma)), F.lit(2.0)))
    total = lambda f: F.aggregate(F.transform("_near", f), F.lit(0.0), lambda a, v: a + v)
    return rows.withColumn("smooth", total(lambda v: weight(v) * v["y"]) / total(weight)).drop("_near")


def measured(bins: DataFrame, peaks: DataFrame, by: str, y: str = "smooth", *, window: int = 24, height: float = 0.5) -> DataFrame:
    """peaks(by, peak, ...) with prominence, baseline, the bases, the crossings of the level that lies `height` of the prominence
    below the peak, between bins, and widths from them: width_bins, sigma_bins, sigma_left, sigma_right, area. The prominence is
    over the higher of the lowest bins within `window` to either side. A peak at an end has itself as the base of that side."""
    if not 0 < height < 1:
        raise ValueError("height must be strictly between 0 and 1")
    keys, extra = [by, "peak"], [c for c in peaks.columns if c not in (by, "peak")]
    along = Window.partitionBy(by).orderBy("bin")
    curve = bins.select(by, "bin", F.col(y).cast("double").alias("_y")).withColumns({"_next": F.lead("_y").over(along), "_last": F.lag("_y").over(along)})
    value, at, peak = F.col("_y"), F.col("bin"), F.col("peak")
    lowest = lambda inside: F.min(F.when(inside, F.struct("_y", "bin")))
    own = F.max(F.when(at == peak, value))
    self_ = F.struct(own.alias("_y"), F.max(F.when(at == peak, at)).alias("bin"))
    bases = peaks.select(*keys).distinct().join(curve, by).groupBy(*keys).agg(own.alias("_top"), F.coalesce(lowest(at.between(peak - window, peak - 1)), self_).alias("_l"), F.coalesce(lowest(at.between(peak + 1, peak + window)), self_).alias("_r"))
    base = bases.withColumn("baseline", F.greatest("_l._y", "_r._y")).withColumn("prominence", F.greatest(F.lit(0.0), F.col("_top") - F.col("baseline")))
    base = base.withColumn("_level", F.col("_top") - height * F.col("prominence"))
    under = value <= F.col("_level")
    crossed = base.join(curve, by).groupBy(*keys, "_top", "_l", "_r", "baseline", "prominence", "_level").agg(
        F.max(F.when(under & (at <= peak), F.struct("bin", "_y", "_next"))).alias("_a"),
        F.min(F.when(under & (at >= peak), F.struct("bin", "_y", "_last"))).alias("_b"),
        F.min("bin").alias("_first"), F.max("bin").alias("_end"),
        F.sum(F.when(at.between(F.col("_l.bin"), F.col("_r.bin")), F.greatest(F.lit(0.0), value - F.col("baseline")))).alias("area"),
    )

    def crossing(outside: str, inner: str, end: str, towards: int) -> Column:
        steep = F.col(f"{outside}.{inner}") - F.col(f"{outside}._y")
        share = F.when(F.abs(steep) < TINY, 0.5).otherwise(clamp((F.col("_level") - F.col(f"{outside}._y")) / steep, 0.0, 1.0))
        return F.when(F.col(outside).isNull(), F.col(end).cast("double")).when(F.col(f"{outside}.bin") == peak, peak.cast("double")).otherwise(F.col(f"{outside}.bin") + towards * share)

    a, b, unit = crossing("_a", "_next", "_first", 1), crossing("_b", "_last", "_end", -1), math.sqrt(2 * math.log(1 / (1 - height)))
    out = crossed.withColumns({"left_crossing": a, "right_crossing": b}).withColumn("width_bins", F.greatest(F.lit(0.5), F.col("right_crossing") - F.col("left_crossing")))
    side = lambda d: F.greatest(F.lit(0.5), d / unit)
    out = out.withColumns({"sigma_bins": F.col("width_bins") / 2 / unit, "sigma_left": side(peak - F.col("left_crossing")), "sigma_right": side(F.col("right_crossing") - peak)})
    found = out.select(*keys, "prominence", "baseline", F.col("_l.bin").alias("left_base"), F.col("_r.bin").alias("right_base"), "left_crossing", "right_crossing", "width_bins", "sigma_bins", "sigma_left", "sigma_right", "area")
    return peaks.select(*keys, *extra).join(found, keys)


def proposed(bins: DataFrame, pairs: DataFrame, by: str, y: str = "smooth") -> DataFrame:
    """pairs(by, g1, g2, g1_found, g2_found: bins of two peaks, and whether they were detected or are only expected there) ->
    (by, g1_left, g1_right, g1_source, g2_left, g2_right, g2_source, g1_fallback, g2_fallback).

    A region reaches OUTER deviations away from the other peak and INNER towards it, LEAST_BINS bins at least; regions that would
    meet end in the middle between the peaks. A peak that was not detected has the width of the other, or DEFAULT_CV of its centre.
    """
    each = pairs.select(by, F.inline(F.array(*[F.struct(F.col(g).alias("peak"), F.lit(g).alias("_g"), F.col(f"{g}_found").alias("_found")) for g in ("g1", "g2")])))
    sizes = measured(bins, each.where("_found"), by, y)
    edges = bins.groupBy(by).agg(F.percentile(F.col("right") - F.col("left"), F.lit(0.5)).alias("_w"), F.min("left").alias("_lo"), F.max("right").alias("_hi"))
    centres = bins.select(by, F.col("bin").alias("peak"), ((F.col("left") + F.col("right")) / 2).alias("_c"))
    rows = each.join(centres, [by, "peak"]).join(sizes.select(by, "peak", "_g", F.when(F.col("_g") == "g1", F.col("sigma_left")).otherwise(F.col("sigma_right")).alias("_own")), [by, "peak", "_g"], "left")
    pick = lambda g, c: F.max(F.when(F.col("_g") == g, F.col(c)))
    wide = rows.groupBy(by).agg(*[pick(g, c).alias(f"{c}_{g}") for g in ("g1", "g2") for c in ("_c", "_own", "_found")]).join(edges, by)
    fallback = F.coalesce(F.col("_own_g1"), F.greatest(F.lit(1.0), DEFAULT_CV * F.col("_c_g1") / F.col("_w")))
    half = lambda s, k: F.greatest(LEAST_BINS * F.col("_w"), k * s * F.col("_w"))
    inside = lambda x: F.greatest(F.col("_lo"), F.least(F.col("_hi"), x))
    s1, s2 = fallback, F.coalesce(F.col("_own_g2"), fallback)
    ends = wide.withColumns({"_1l": inside(F.col("_c_g1") - half(s1, OUTER)), "_1r": inside(F.col("_c_g1") + half(s1, INNER)), "_2l": inside(F.col("_c_g2") - half(s2, INNER)), "_2r": inside(F.col("_c_g2") + half(s2, OUTER)), "_mid": (F.col("_c_g1") + F.col("_c_g2")) / 2})
    meet = F.col("_1r") >= F.col("_2l")
    source = lambda g: F.when(F.col(f"_found_{g}"), "detected").otherwise("inferred").alias(f"{g}_source")
    return ends.select(
        by, F.col("_1l").alias("g1_left"), F.when(meet, F.least("_1r", "_mid")).otherwise(F.col("_1r")).alias("g1_right"), source("g1"),
        F.when(meet, F.greatest("_2l", "_mid")).otherwise(F.col("_2l")).alias("g2_left"), F.col("_2r").alias("g2_right"), source("g2"),
        F.col("_own_g1").isNull().alias("g1_fallback"), F.col("_own_g2").isNull().alias("g2_fallback"),
    )


def estimated(bins: DataFrame, regions: DataFrame, by: str, y: str = "smooth", *, height: float = 0.5, fwhm: bool = False) -> DataFrame:
    """regions(by, label, left, right, clean: left or right) -> the same with peak, mean, sigma, cv, area, method: what the bins
    whose centres are in a region tell of its peak.

    sigma, by the first of these that is above zero: from the distance to where the clean flank falls to `height` of the peak
    (flank); the deviation of what lies above a straight line between the region's ends (moment); the region's width over 4, or
    over the 2.35 of a half width with fwhm (span). A region without bins has nulls and the method none.
    """
    keys, v, at = [by, "label"], F.col("_y"), F.col("bin")
    level = min(0.95, max(0.05, height))
    bounds = regions.select(*keys, F.col("left").alias("_left"), F.col("right").alias("_right"), F.col("clean").alias("_clean"))
    width = bins.groupBy(by).agg(F.min_by(F.col("right") - F.col("left"), "bin").alias("_w"))
    curve = bins.select(by, "bin", ((F.col("left") + F.col("right")) / 2).alias("_c"), F.col(y).cast("double").alias("_y"))
    inside = bounds.join(curve, by).where(F.col("_c").between(F.col("_left"), F.col("_right")))
    top = inside.groupBy(*keys).agg(F.min(F.struct((-v).alias("v"), at.alias("bin"), F.col("_c").alias("c"))).alias("_p"), F.min(F.struct("bin", "_y")).alias("_a"), F.max(F.struct("bin", "_y")).alias("_b"))
    rows = inside.join(top, keys)
    line = F.col("_a._y") + (at - F.col("_a.bin")) / F.greatest(F.lit(1), F.col("_b.bin") - F.col("_a.bin")) * (F.col("_b._y") - F.col("_a._y"))
    weight, away = F.greatest(F.lit(0.0), v - line), F.col("_c") - F.col("_p.c")
    low = v <= -F.col("_p.v") * level
    sums = rows.groupBy(*keys, "_left", "_right", "_clean", "_p", "_a", "_b").agg(
        F.max(F.when(low & (at < F.col("_p.bin")), at)).alias("_l"), F.min(F.when(low & (at > F.col("_p.bin")), at)).alias("_r"),
        F.sum(weight).alias("_s0"), F.sum(weight * away).alias("_s1"), F.sum(weight * away * away).alias("_s2"),
    ).join(width, by)
    peak = -F.col("_p.v")
    distance = F.when(F.col("_clean") == "right", F.col("_r") - F.col("_p.bin")).otherwise(F.col("_p.bin") - F.col("_l"))
    flank = F.when((peak > 0) & (distance > 0), distance / math.sqrt(-2 * math.log(height)) * F.col("_w"))
    moment = F.when(F.col("_s0") > TINY, F.sqrt(F.greatest(F.lit(TINY), F.col("_s2") / F.col("_s0") - F.pow(F.col("_s1") / F.col("_s0"), F.lit(2.0)))))
    span = F.greatest(F.col("_w"), (F.col("_right") - F.col("_left")) / (2.354820045 if fwhm else 4.0))
    sigma = F.coalesce(F.when(flank > 0, flank), F.when(moment > 0, moment), span)
    method = F.when(flank > 0, "flank").when(moment > 0, "moment").otherwise("span")
    tall = F.greatest(F.lit(0.0), peak - F.least("_a._y", "_b._y"))
    area = F.greatest(F.lit(1.0), tall * math.sqrt(2 * math.pi) * F.col("sigma") / F.greatest(F.lit(TINY), F.col("_w")))
    found = sums.withColumns({"sigma": sigma, "method": method}).select(*keys, F.col("_p.bin").alias("peak"), F.col("_p.c").alias("mean"), "sigma", (F.col("sigma") / F.greatest(F.lit(TINY), F.col("_p.c"))).alias("cv"), area.alias("area"), "method")
    return regions.join(found, keys, "left").withColumn("method", F.coalesce("method", F.lit("none")))
