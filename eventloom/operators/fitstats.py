"""Diagnostics of fitted histograms: residuals, their structure, goodness of fit, components and outcomes. All in SQL terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pearson_residual, poisson_deviance, safe_divide


def goodness(bins: DataFrame, by: str, y: str, mu: str, parameters: int) -> DataFrame:
    """(by, bins, sse, rmse, r2, chi2, deviance, reduced_deviance, aic, aicc, bic) of counts y under expectations mu."""
    r = F.col(y) - F.col(mu)
    one = bins.groupBy(by).agg(F.count(F.lit(1)).alias("bins"), F.sum(r * r).alias("sse"), F.var_pop(y).alias("_var"), F.sum(F.pow(pearson_residual(F.col(y), F.col(mu)), 2)).alias("chi2"), F.sum(poisson_deviance(F.col(y), F.col(mu))).alias("deviance"))
    n, k = F.col("bins"), parameters
    return one.select(by, "bins", "sse", F.sqrt(F.col("sse") / n).alias("rmse"), (1 - safe_divide(F.col("sse"), F.col("_var") * n)).alias("r2"), "chi2", "deviance", safe_divide(F.col("deviance"), n - k).alias("reduced_deviance"), (F.col("deviance") + 2 * k).alias("aic"), (F.col("deviance") + 2 * k + safe_divide(F.lit(2.0 * k * (k + 1)), n - k - 1)).alias("aicc"), (F.col("deviance") + k * F.log(n)).alias("bic"))


def residual_structure(bins: DataFrame, by: str, order: str, residual: str) -> DataFrame:
    """(by, lag1, durbin_watson, runs_z): autocorrelation of neighbours, squared steps over squares, and the runs test of signs."""
    w = Window.partitionBy(by).orderBy(order)
    centred = bins.withColumn("_m", F.avg(residual).over(Window.partitionBy(by))).withColumn("_c", F.col(residual) - F.col("_m"))
    step = centred.withColumns({"_p": F.lag("_c").over(w), "_d": F.col(residual) - F.lag(residual).over(w)})
    one = step.groupBy(by).agg(safe_divide(F.sum(F.col("_c") * F.col("_p")), F.sum(F.col("_c") * F.col("_c"))).alias("lag1"), safe_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col(residual) * F.col(residual))).alias("durbin_watson"))
    signed = bins.where(F.col(residual) != 0).withColumn("_s", F.signum(residual)).withColumn("_turn", (F.col("_s") != F.lag("_s").over(w)).cast("int"))
    runs = signed.groupBy(by).agg(F.count_if(F.col("_s") > 0).cast("double").alias("_a"), F.count_if(F.col("_s") < 0).cast("double").alias("_b"), (F.coalesce(F.sum("_turn"), F.lit(0)) + 1).alias("_runs"))
    n = F.col("_a") + F.col("_b")
    mean, var = 2 * F.col("_a") * F.col("_b") / n + 1, 2 * F.col("_a") * F.col("_b") * (2 * F.col("_a") * F.col("_b") - n) / (n * n * (n - 1))
    z = F.when(n < 4, F.lit(None)).when((F.col("_a") == 0) | (F.col("_b") == 0), float("-inf")).otherwise(safe_divide(F.col("_runs") - mean, F.sqrt(var)))
    return one.join(runs.select(by, z.cast("double").alias("runs_z")), by, "left")


def local_bias(bins: DataFrame, by: str, order: str, residual: str, width: int = 11) -> DataFrame:
    """(by, bias, at): the largest mean, in size, of `width` neighbouring residuals over the sample's robust residual scale, and
    where it starts. Fewer bins than `width` are one window; a scale of zero counts as 1e-12."""
    w, sample = Window.partitionBy(by).orderBy(order).rowsBetween(0, width - 1), Window.partitionBy(by)
    centred = bins.withColumn("_c", F.col(residual) - F.percentile(residual, F.lit(0.5)).over(sample))
    scaled = centred.withColumn("_scale", F.greatest(1.4826 * F.percentile(F.abs("_c"), F.lit(0.5)).over(sample), F.lit(1e-12)))
    full = scaled.withColumns({"_m": F.avg(residual).over(w), "_n": F.count(residual).over(w), "_all": F.count(residual).over(sample)}).where(F.col("_n") == F.least(F.lit(width), F.col("_all")))
    top = F.row_number().over(Window.partitionBy(by).orderBy(F.abs(F.col("_m")).desc(), order))
    return full.withColumn("_k", top).where("_k = 1").select(by, (F.abs(F.col("_m")) / F.col("_scale")).alias("bias"), F.col(order).alias("at"))


def component_moments(curve: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, total, mean, sd) of a curve y over x."""
    one = curve.groupBy(by).agg(F.sum(y).alias("total"), F.sum(F.col(x) * F.col(y)).alias("_1"), F.sum(F.col(x) * F.col(x) * F.col(y)).alias("_2"))
    mean = safe_divide(F.col("_1"), F.col("total"))
    return one.select(by, "total", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), safe_divide(F.col("_2"), F.col("total")) - mean * mean)).alias("sd"))


def trapezoid(curve: DataFrame, by: str, x: str, y: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(x)
    step = curve.withColumn("_a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return step.groupBy(by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def local_maxima(bins: DataFrame, by: str, order: str, y: str) -> DataFrame:
    """Bins above both neighbours; of equal neighbouring bins, the middle one (the lower of two). The first and the last bin are
    none, but a plateau may reach the end. order: consecutive integers."""
    w, island = Window.partitionBy(by).orderBy(order), Window.partitionBy(by, "_island")
    near = bins.withColumns({"_p": F.lag(y).over(w), "_n": F.lead(y).over(w), "_end": F.max(order).over(Window.partitionBy(by))})
    runs = near.withColumn("_island", F.sum((~F.col(y).eqNullSafe(F.col("_p"))).cast("int")).over(w))
    edges = {"_from": F.min(order).over(island), "_to": F.max(order).over(island), "_before": F.min(F.when(F.col("_p") != F.col(y), F.col("_p"))).over(island), "_after": F.min(F.when(F.col("_n") != F.col(y), F.col("_n"))).over(island)}
    above = (F.col(y) > F.col("_before")) & ((F.col("_to") == F.col("_end")) | (F.col(y) > F.col("_after"))) & (F.col("_from") < F.col("_end"))
    middle = F.col(order) == F.floor((F.col("_from") + F.col("_to")) / 2)
    return runs.withColumns(edges).where(above & middle).drop("_p", "_n", "_end", "_island", *edges)


def peak_pairs(peaks: DataFrame, by: str, x: str, y: str, low: float = 1.8, high: float = 2.1, target: float = 2.0, width: float = 0.08) -> DataFrame:
    """(by, x1, x2, ratio, score, rank): pairs of a sample's peaks in the ratio's range, ranked by the root of their heights'
    product times a Gaussian of the ratio. A sample has few peaks."""
    one = peaks.select(by, F.col(x).alias("x1"), F.col(y).alias("_1"))
    two = peaks.select(by, F.col(x).alias("x2"), F.col(y).alias("_2"))
    ratio = F.col("x2") / F.col("x1")
    pairs = one.join(two, by).where((F.col("x1") > 0) & (F.col("x2") > F.col("x1")) & ratio.between(low, high))
    score = F.sqrt((F.col("_1") * F.col("_2")).cast("double")) * F.exp(-0.5 * F.pow((ratio - target) / width, 2))
    scored = pairs.select(by, "x1", "x2", ratio.alias("ratio"), score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "x1", "x2")))


def qc_outcome(required: Column, waived: Column, status: Column) -> Column:
    """Success, what a user has to know, or failure of a stage, by its status."""
    return F.when(status == "cancelled", "cancelled").when(waived, "waived").when(status.isin("applied", "passed_no_loss"), "success").when(status == "skipped_optional", "skipped_expected").when(status == "degraded", "warning").when(required | (status == "failed"), "failed").otherwise("skipped_expected")


def reportable(fits: DataFrame) -> DataFrame:
    """fits(phase_g1, phase_s, phase_g2, converged, reasons, cv, cv_upper) with valid: no reason against, finite fractions that add up
    to one, converged, and no width at its bound."""
    whole = F.abs(F.col("phase_g1") + F.col("phase_s") + F.col("phase_g2") - 1) <= 1e-6
    each = F.least("phase_g1", "phase_s", "phase_g2") >= 0
    return fits.withColumn("valid", F.coalesce((F.size("reasons") == 0) & whole & each & F.col("converged") & (F.col("cv") < F.col("cv_upper") * (1 - 1e-9)), F.lit(False)))
