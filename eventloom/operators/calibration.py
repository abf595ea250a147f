"""Which samples of a cohort are on the same axis, which may share regions of peaks, and what a fit of all of them came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohort import can_share, shared_regions

#: What stands for an absent keyword, and the score by which the best pair of peaks must lead.
DEFAULTS = {"amplification": "0,0", "spillover": "none", "instrument": "unspecified"}
LEAST_MARGIN = 0.08
FIELDS = ("channel", "name", "stain", "range", "datatype", "bits", "amplification", "spillover", "instrument")


def fingerprint(fields: dict[str, Column]) -> Column:
    """struct(FIELDS) of an axis: its channel and the keywords that fix its scale. Null without a channel, a datatype, or a range
    and a number of bits above zero: such an axis is known to equal no other. Texts that are absent have their defaults."""
    text = {k: F.coalesce(fields.get(k, F.lit(None)).cast("string"), F.lit(DEFAULTS.get(k, ""))) for k in FIELDS if k not in ("range", "bits")}
    text["amplification"] = F.when(text["amplification"] == "", DEFAULTS["amplification"]).otherwise(text["amplification"])
    size = {k: fields.get(k, F.lit(None)).cast("double") for k in ("range", "bits")}
    known = (text["channel"] != "") & (text["datatype"] != "")
    for x in size.values():
        known = known & x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.when(known, F.struct(*[(size | text)[k].alias(k) for k in FIELDS]))


def classes(samples: DataFrame, by: str, axis: str) -> DataFrame:
    """(axis, samples, first): a row per different fingerprint, with the number of its samples and the first of them; samples of
    unknown axes are in no class."""
    return samples.where(F.col(axis).isNotNull()).groupBy(axis).agg(F.count(F.lit(1)).alias("samples"), F.min(by).alias("first"))


def review_reasons(status: Column, alternatives: Column, margin: Column, g1_source: Column, g2_source: Column, fallback: Column) -> Column:
    """Why a detection of peaks must be looked at before it is used, as an array; empty: it need not."""
    found = F.coalesce(status, F.lit("not_detected"))
    reasons = [
        F.when(found != "detected", found), F.when((alternatives > 0) & (margin <= LEAST_MARGIN), "ambiguous_alternatives"),
        F.when((g1_source == "inferred") | (g2_source == "inferred"), "inferred_region"), F.when(fallback, "width_fallback"),
    ]
    return F.array_distinct(F.array_compact(F.array(*reasons)))


def shareable(samples: DataFrame, cohort: str, order: str) -> DataFrame:
    """samples(cohort, order, axis, status, confidence, reasons, range, the four ends g1_left, g1_right, g2_left, g2_right) with
    trusted (its detection may be shared: ends, no reason for review, confidence, a known axis) and included: trusted, and on the
    axis of the cohort's first trusted sample."""
    ends = ("g1_left", "g1_right", "g2_left", "g2_right")
    whole = F.lit(True)
    for c in ends:
        whole = whole & F.col(c).isNotNull()
    trusted = F.coalesce(whole & (F.size("reasons") == 0) & can_share(F.col("status"), F.col("confidence")) & F.col("axis").isNotNull(), F.lit(False))
    marked = samples.withColumn("trusted", trusted)
    first = marked.where("trusted").groupBy(F.col(cohort).alias("_cohort")).agg(F.min_by("axis", order).alias("_reference"))
    out = marked.join(first, F.col(cohort).eqNullSafe(F.col("_cohort")), "left")
    return out.withColumn("included", F.coalesce(F.col("trusted") & (F.col("axis") == F.col("_reference")), F.lit(False))).drop("_cohort", "_reference")


def fit_all(samples: DataFrame, cohort: str, order: str) -> DataFrame:
    """samples of shareable() with mode (shared_median_normalized or independent), the ends used, outcome and why.

    Included samples use their cohort's shared regions, if there are two at least and the ends are in order; all others their own.
    The result of a fit is a struct column fit(cancelled, computed, valid, converged), null if none was made.
    """
    ends = ("g1_left", "g1_right", "g2_left", "g2_right")
    marked = shareable(samples, cohort, order)
    regions = shared_regions(marked.where("included"), cohort, order).select(F.col(cohort).alias("_cohort"), *[F.col(c).alias(f"_{c}") for c in ends])
    both = marked.join(regions, F.col(cohort).eqNullSafe(F.col("_cohort")), "left")
    shared = F.col("included") & F.col("_g1_left").isNotNull()
    found = F.col("g1_left").isNotNull() & F.col("g1_right").isNotNull() & F.col("g2_left").isNotNull() & F.col("g2_right").isNotNull()
    fit = F.col("fit")
    outcome = (
        F.when(~found, F.struct(F.lit("detection_failed").alias("outcome"), F.lit("no_peak_regions").alias("why")))
        .when(fit.isNull(), F.struct(F.lit("skipped").alias("outcome"), F.lit("skipped").alias("why")))
        .when(fit["cancelled"], F.struct(F.lit("cancelled").alias("outcome"), F.lit("fit_cancelled").alias("why")))
        .when(~F.coalesce(fit["computed"], F.lit(False)), F.struct(F.lit("fit_failed").alias("outcome"), F.lit("no_valid_model").alias("why")))
        .when(~F.coalesce(fit["valid"], F.lit(True)), F.struct(F.lit("fit_failed").alias("outcome"), F.lit("invalid_for_reporting").alias("why")))
        .when(fit["converged"], F.struct(F.lit("converged_reportable").alias("outcome"), F.lit("converged_reportable").alias("why")))
        .otherwise(F.struct(F.lit("computed_nonconverged").alias("outcome"), F.lit("nonconverged").alias("why")))
    )
    used = [F.when(shared, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ends]
    keep = [c for c in marked.columns if c not in ends]
    return both.select(*keep, *used, F.when(shared, "shared_median_normalized").otherwise("independent").alias("mode"), outcome.alias("_o")).select(*keep, *ends, "mode", "_o.outcome", "_o.why")


def accounted(outcomes: DataFrame, cohort: str) -> DataFrame:
    """(cohort, attempted, success, failed, skipped, cancelled, shared); a count that does not add up is an error."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    one = outcomes.groupBy(cohort).agg(F.count(F.lit(1)).alias("attempted"), count("converged_reportable").alias("success"), count("computed_nonconverged", "detection_failed", "fit_failed").alias("failed"), count("skipped").alias("skipped"), count("cancelled").alias("cancelled"), F.count_if(F.col("mode") == "shared_median_normalized").alias("shared"))
    adds = F.col("success") + F.col("failed") + F.col("skipped") + F.col("cancelled") == F.col("attempted")
    return one.withColumn("attempted", F.when(adds, F.col("attempted")).otherwise(F.raise_error(F.lit("outcomes do not add up")).cast("long")))


def waived(steps: DataFrame, waivers: DataFrame, by: str) -> DataFrame:
    """Required filters that are not applied, rows of qcrun's steps (by, name, status, code), with waiver (its reason, or null) and
    approved: whether all such filters of the sample are waived. waivers(by, name, reason); blank reasons waive nothing."""
    open_ = steps.where(F.col("status") != "applied").select(by, "name", "status", "code")
    given = waivers.where(F.length(F.trim("reason")) > 0).groupBy(by, "name").agg(F.min("reason").alias("waiver"))
    out = open_.join(given, [by, "name"], "left")
    return out.withColumn("approved", F.min(F.col("waiver").isNotNull()).over(Window.partitionBy(by)))  # a row per filter of a sample
