"""Whether a sample is fit to be modelled, and every reason why not, before any fit is tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cohort import invalid_region_keys

#: What a fit needs at least, how much of a channel may not be DNA, what loss must be acknowledged, and the statuses
#: of a required filter that let a fit pass.
LEAST_EVENTS, LEAST_BINS, LEAST_SUPPORT = 100, 5, 10
MOST_INELIGIBLE, CRITICAL_LOSS = 0.25, 50.0
ACCEPTABLE = ("applied", "passed_no_loss", "waived")


def histogram_fingerprint(bins: DataFrame, by: str) -> DataFrame:
    """(by, fingerprint): a digest of a histogram's bins, edges and counts; equal for equal histograms, whatever the order of
    rows. A sample has a bounded number of bins."""
    parts = F.array_sort(F.collect_list(F.struct("bin", "left", "right", "count")))
    return bins.groupBy(by).agg(F.sha2(F.to_json(parts).cast("binary"), 256).alias("fingerprint"))


def summarized(bins: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """(by, retained, nonempty, finite, support_g1, support_g2) of bins(by, bin, left, right, count): the events of bins whose
    centres lie in the regions(by, regions struct of four ends); support is null without regions."""
    centre, n, r = (F.col("left") + F.col("right")) / 2, F.col("count"), F.col("_r")
    support = lambda g: F.when(r.isNotNull(), F.when(centre.between(r[f"{g}_left"], r[f"{g}_right"]), n).otherwise(0))
    rows = bins.join(regions.select(by, F.col("regions").alias("_r")), by, "left")
    finite = F.coalesce((n >= 0) & ~F.isnan(n.cast("double")) & (n < float("inf")), F.lit(False))
    return rows.groupBy(by).agg(F.sum(n).alias("retained"), F.count_if(n > 0).alias("nonempty"), F.min(finite).alias("finite"), F.sum(support("g1")).alias("support_g1"), F.sum(support("g2")).alias("support_g2"))


def _reasons(found: Column) -> Column:
    c, ends = F.col, F.col("regions")
    ineligible = c("rejected") / c("mask_retained") > MOST_INELIGIBLE
    eligible = c("eligibility").isNull() | (c("eligibility") == "linear")
    bad = lambda s: s.isin("failed", "cancelled")
    refused = F.exists("qc", lambda s: F.when(s["required"], ~F.coalesce(s["status"].isin(*ACCEPTABLE), F.lit(False))).otherwise(F.coalesce(bad(s["status"]), F.lit(False))))
    critical = F.exists("qc", lambda s: (s["percent"] > CRITICAL_LOSS) & ~F.coalesce(s["acknowledged"], F.lit(False)))
    unfit = F.exists(F.map_values("config"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    told = [
        (~found, "histogram_missing"), (found & ~c("finite"), "histogram_invalid"), (found & (c("mask_retained") > 0) & ineligible, "dna_ineligible"),
        (found & (c("seen_fingerprint") != c("fingerprint")), "histogram_stale"), (ends.isNull(), "regions_missing"), (ends.isNotNull() & (F.size(invalid_region_keys(ends)) > 0), "constraint_invalid"),
        (ends.isNotNull() & ~F.coalesce(c("reviewed"), F.lit(False)), "regions_unreviewed"), (c("stale"), "regions_stale"), (F.coalesce(c("channel"), F.lit("")) == "", "dna_ineligible"),
        (eligible & (F.coalesce(c("transforms"), F.lit(0)) != 0), "fcs_transform_state_invalid"), (found & (c("retained") < LEAST_EVENTS), "events_insufficient"),
        (found & (c("nonempty") < LEAST_BINS), "histogram_support_insufficient"), (found & ends.isNotNull() & (F.least("support_g1", "support_g2") < LEAST_SUPPORT), "peak_support_insufficient"),
        (F.coalesce(refused, F.lit(False)), "qc_not_passed"), (F.coalesce(critical, F.lit(False)), "qc_critical_removal"), (c("config").isNull() | F.coalesce(unfit, F.lit(False)), "configuration_invalid"),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(why, F.lit(False)), F.lit(name)) for why, name in told], F.when(~eligible, c("eligibility")))))


def preflight(bins: DataFrame, samples: DataFrame, by: str) -> DataFrame:
    """(by, passed, reasons, retained) of every row of samples.

    samples(by, mask_retained and rejected: events that the filters kept, and how many of these are no DNA values; seen_fingerprint:
    of the histogram on which regions were found, null if unknown; regions: struct of four ends, or null; reviewed, stale; channel;
    eligibility: linear, null, or the code that speaks against it; transforms: how often values were transformed; qc:
    array<struct<name, required, status, percent, acknowledged>>; config: map of numbers). A sample without bins has no histogram.
    """
    facts = summarized(bins, samples, by).join(histogram_fingerprint(bins, by), by)
    rows = samples.join(facts, by, "left")
    out = rows.select(by, _reasons(F.col("fingerprint").isNotNull()).alias("reasons"), F.coalesce("retained", F.lit(0)).alias("retained"))
    return out.select(by, (F.size("reasons") == 0).alias("passed"), "reasons", "retained")
