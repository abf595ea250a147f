"""Review of a whole cohort: regions, calibration and shared proposals, outcomes, acquisition-time summaries, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles

#: The least confidence of a proposal that may be shared, and the shares of events lost that are high and critical.
LEAST_CONFIDENCE, HIGH_LOSS, CRITICAL_LOSS = 0.65, 20.0, 50.0


def invalid_region_keys(regions: Column) -> Column:
    """The ends of a struct(g1_left, g1_right, g2_left, g2_right) that are not finite, or out of order with another."""
    end = {k: regions[k] for k in ("g1_left", "g1_right", "g2_left", "g2_right")}
    lost = [F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.array(F.lit(k))) for k, v in end.items()]
    bad = [("g1_left", "g1_right", end["g1_left"] >= end["g1_right"]), ("g2_left", "g2_right", end["g2_left"] >= end["g2_right"]), ("g1_right", "g2_left", end["g1_right"] > end["g2_left"])]
    pairs = [F.when(wrong & ~F.isnan(end[a]) & ~F.isnan(end[b]), F.array(F.lit(a), F.lit(b))) for a, b, wrong in bad]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*lost, *pairs))))


def can_share(status: Column, confidence: Column) -> Column:
    """Whether a detection may be shared with other samples."""
    return F.coalesce((status == "detected") & ~F.isnan(confidence) & (F.abs(confidence) < float("inf")) & (confidence >= LEAST_CONFIDENCE), F.lit(False))


def shared_regions(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows(by, order, range, g1_left, g1_right, g2_left, g2_right) -> (by, samples and the four ends): medians of centres and
    widths in shares of the range, scaled by the range of the first sample, where two samples or more give regions in order."""
    part = rows
    for g in ("g1", "g2"):
        part = part.withColumns({f"{g}_c": (F.col(f"{g}_left") + F.col(f"{g}_right")) / (2 * F.col("range")), f"{g}_w": (F.col(f"{g}_right") - F.col(f"{g}_left")) / F.col("range")})
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.min_by("range", order).alias("range")).where("samples >= 2")
    middle = quantiles(part, by, ["g1_c", "g1_w", "g2_c", "g2_w"], [0.5]).groupBy(by).agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in ("g1_c", "g1_w", "g2_c", "g2_w")])
    out = out.join(middle, by)
    ends = [((F.col(f"{g}_c") + side * F.col(f"{g}_w") / 2) * F.col("range")).alias(f"{g}_{end}") for g in ("g1", "g2") for side, end in ((-1, "left"), (1, "right"))]
    return out.select(by, "samples", *ends).where("g1_left < g1_right AND g1_right <= g2_left AND g2_left < g2_right")


def bulk_outcomes(fits: DataFrame, status: str) -> DataFrame:
    """One row (attempted, success, failed, skipped, cancelled) over the outcomes of a cohort's fits."""
    count = lambda *names: F.count_if(F.col(status).isin(*names))
    return fits.agg(F.count(F.lit(1)).alias("attempted"), count("converged_reportable").alias("success"), count("computed_nonconverged", "detection_failed", "fit_failed").alias("failed"), count("skipped").alias("skipped"), count("cancelled").alias("cancelled"))


def reason_counts(bins: DataFrame, by: str, reasons: str) -> DataFrame:
    """(by, reason, n): how many bins have each reason."""
    return bins.select(by, F.explode(reasons).alias("reason")).groupBy(by, "reason").agg(F.count(F.lit(1)).alias("n"))


def time_summary(bins: DataFrame, by: str, n: str, reasons: str) -> DataFrame:
    """(by, entered, removed, regions, percent, level): events in flagged bins, runs of them (bins are ordered by `first`), and
    how serious the loss is."""
    w = Window.partitionBy(by).orderBy("first")
    flagged = bins.withColumn("_f", (F.size(reasons) > 0).cast("int")).withColumn("_new", F.col("_f") * (1 - F.coalesce(F.lag("_f").over(w), F.lit(0))))
    one = flagged.groupBy(by).agg(F.sum(n).alias("entered"), F.sum(F.col("_f") * F.col(n)).alias("removed"), F.sum("_new").alias("regions"))
    percent = 100.0 * F.col("removed") / F.col("entered")
    return one.select(by, "entered", "removed", "regions", percent.alias("percent"), F.when(percent > CRITICAL_LOSS, "critical").when(percent > HIGH_LOSS, "high").otherwise("normal").alias("level"))


def qc_columns(stages: DataFrame, by: str, order: str, status: str, entered: str, left: str) -> DataFrame:
    """(by, total, status, lost, percent): events before the first stage, the first status that is a failure (in the order of
    stages) or Complete, and what was lost by the last."""
    first_bad = F.min_by(F.when(F.col(status).isin("failed", "degraded", "cancelled"), F.col(status)), F.when(F.col(status).isin("failed", "degraded", "cancelled"), F.col(order)))
    one = stages.groupBy(by).agg(F.min_by(entered, order).alias("total"), F.coalesce(first_bad, F.lit("Complete")).alias("status"), F.max_by(left, order).alias("_left"))
    lost = F.col("total") - F.col("_left")
    return one.select(by, "total", "status", lost.alias("lost"), F.when(F.col("total") > 0, 100.0 * lost / F.col("total")).alias("percent"))


def start_dispersion(starts: DataFrame, by: str, value: str, objective: str) -> DataFrame:
    """(by, starts, least, most, mean, cv, agreement): spread of a parameter over starts, and the share of starts whose
    objective is within a hundredth of the best one's."""
    best = starts.groupBy(by).agg(F.min(objective).alias("_best"))
    near = F.col(objective) <= F.col("_best") + 0.01 * (F.abs("_best") + 1)
    one = starts.join(best, by).groupBy(by).agg(F.count(F.lit(1)).alias("starts"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd"), F.avg(near.cast("int")).alias("agreement"))
    return one.select(by, "starts", "least", "most", "mean", F.when(F.col("mean") != 0, F.col("_sd") / F.abs("mean")).otherwise(0.0).alias("cv"), "agreement")


def noise_floor(bins: DataFrame, by: str, order: str, y: str) -> DataFrame:
    """(by, noise): the median step between neighbouring bins, as a standard deviation, 1 at least."""
    step = bins.select(by, F.abs(F.col(y) - F.lag(y).over(Window.partitionBy(by).orderBy(order))).cast("double").alias("step")).where("step IS NOT NULL")
    return bins.select(by).distinct().join(quantiles(step, by, "step", [0.5]), by, "left").select(by, F.greatest(F.lit(1.0), F.coalesce(F.col("q") / 0.954, F.lit(1.0))).alias("noise"))


def visible_range(rows: DataFrame, low: str, high: str, override: tuple[float, float] | None = None) -> DataFrame:
    """One row (low, high): the union of ranges, or an override whose ends are in order."""
    if override is not None and override[1] > override[0]:
        return rows.sparkSession.createDataFrame([tuple(map(float, override))], "low double, high double")
    return rows.agg(F.min(low).alias("low"), F.max(high).alias("high"))


def strided(events: DataFrame, by: str, index: str, most: int = 50_000) -> DataFrame:
    """Every floor(n / most)-th event of a sample, by its index."""
    n = events.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    return events.join(n, by).where(F.pmod(F.col(index), F.greatest(F.lit(1), F.floor(F.col("_n") / most))) == 0).drop("_n")


def nearest_index(rows: DataFrame, by: str, index: str, x: str, target: float) -> DataFrame:
    """(by, index): where x is nearest to target, the first of equals."""
    return rows.where(F.col(x).isNotNull()).groupBy(by).agg(F.min_by(index, F.struct(F.abs(F.col(x) - target), index)).alias(index))


def point_bin(x: Column, low: float, width: float, bins: int) -> Column:
    """The bin that holds x, null outside."""
    at = F.floor((x - low) / width)
    return F.when((at >= 0) & (at < bins), at)


def cohort_totals(events: DataFrame, by: str) -> DataFrame:
    """One row (samples, events)."""
    per = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(by).alias("samples"), F.sum("n").alias("events"))


def sample_hues(rows: DataFrame, group: str) -> DataFrame:
    """(group, hue): evenly spaced hues in the order of groups; 210 for one alone."""
    places = rows.select(group).distinct().withColumn("_k", F.row_number().over(Window.orderBy(group)) - 1)  # a row per group
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return places.select(group, F.when(total > 1, F.floor(F.col("_k") * 360 / total + 0.5) % 360).otherwise(210).alias("hue"))
