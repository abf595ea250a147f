"""Statistics that were asked for once, computed again for samples that come later.

The plan is a table (channel, metric, mask): what was asked for, mask being the name of a filter or empty. It is compiled into one
aggregation over all its channels and masks, and one selection of medians if any is asked for.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from .beside import beside
from .ranking import quantiles

PLAN = "channel string, metric string, mask string"
METRICS = ("n", "mean", "sd", "min", "max", "median")
MOST = 4096  # entries of a plan, which becomes expressions


def recorded(plan: DataFrame, channel: str, metrics: Iterable[str], mask: str = "") -> DataFrame:
    """plan with these metrics of a channel; what it has already stays once."""
    metrics = list(metrics)
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
    return plan.unionByName(plan.sparkSession.createDataFrame([(channel, m, mask) for m in metrics], PLAN)).distinct()


def plan_of_columns(spark: SparkSession, columns: Iterable[str]) -> DataFrame:
    """The plan that columns named channel:metric tell of; other names and unknown metrics are passed over."""
    parts = (c.rpartition(":") for c in columns)
    return spark.createDataFrame(sorted({(c, m, "") for c, mark, m in parts if c and mark and m in METRICS}), PLAN)


def computed(events: DataFrame, by: str, plan: DataFrame, masks: dict[str, Column] | None = None) -> DataFrame:
    """(by, channel, mask, metric, value) of the plan, over finite values from zero up of events for which the mask is true or
    null. Channels that the events lack and masks that are not given are passed over; a sample without values has n 0 and null in
    the other metrics."""
    asked = [(r.channel, r.mask or "", r.metric) for r in plan.distinct().limit(MOST + 1).collect()]
    if len(asked) > MOST:
        raise ValueError(f"a plan of over {MOST} entries")
    masks, have = masks or {}, {c.lower(): c for c in events.columns}
    asked = [(c, m, x) for c, m, x in asked if c.lower() in have and (not m or m in masks) and x in METRICS]
    pairs = sorted({(c, m) for c, m, _ in asked})
    if not pairs:
        return events.select(by, *[F.lit(None).cast("string").alias(c) for c in ("channel", "mask", "metric")], F.lit(None).cast("double").alias("value")).limit(0)

    def value(channel: str, mask: str) -> Column:
        x = F.col(f"`{have[channel.lower()]}`").cast("double")
        return F.when(is_finite(x) & (x >= 0) & (F.coalesce(masks[mask], F.lit(True)) if mask else F.lit(True)), x)

    wide = events.select(F.col(by).alias("_by"), *[value(c, m).alias(f"v{k}") for k, (c, m) in enumerate(pairs)])
    sums = [F.struct(F.lit(f"v{k}").alias("k"), F.count(f"v{k}").cast("double").alias("n"), F.avg(f"v{k}").alias("mean"), F.stddev_pop(f"v{k}").alias("sd"), F.min(f"v{k}").alias("min"), F.max(f"v{k}").alias("max")) for k in range(len(pairs))]
    out = wide.groupBy("_by").agg(F.array(*sums).alias("_s")).select("_by", F.inline("_s"))
    middled = [f"v{k}" for k, (c, m) in enumerate(pairs) if (c, m, "median") in asked]
    if middled:
        middle = quantiles(wide, "_by", middled, [0.5]).select(F.col("_by").alias("_b"), F.col("column").alias("_c"), F.col("q").alias("median"))
        out = out.join(middle, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("k") == F.col("_c")), "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    metric = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    entries = [(f"v{k}", c, m, x) for k, (c, m) in enumerate(pairs) for x in METRICS if (c, m, x) in asked]
    wanted = events.sparkSession.createDataFrame(entries, "k string, channel string, mask string, metric string")  # MOST rows at most
    return out.select("_by", "k", metric).join(F.broadcast(wanted), ["k", "metric"]).select(F.col("_by").alias(by), "channel", "mask", "metric", "value")


def replayed(events: DataFrame, by: str, plan: DataFrame, done: DataFrame, masks: dict[str, Column] | None = None) -> DataFrame:
    """done, rows of computed(), and the plan's statistics of the samples that it lacks."""
    channels = {r.channel.lower() for r in plan.select("channel").distinct().limit(MOST + 1).collect()}
    over = [c for c in events.columns if c.lower() in channels] or [by]
    fresh = beside(events, done.select(by).distinct(), by, over, "left_anti", null_safe=True)
    return done.unionByName(computed(fresh, by, plan, masks))


def new_files(spark: SparkSession, folder: str, done: DataFrame, by: str) -> list[str]:
    """The Parquet files of a folder (one or more a sample, named after it up to the first dot) of samples that done lacks. Only
    names are listed."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [f.getPath().toString() for f in fs.listStatus(jvm) if f.getPath().getName().endswith(".parquet")]
    listed = spark.createDataFrame([(p, posixpath.basename(p).partition(".")[0]) for p in paths], "path string, sample string")
    return sorted(r.path for r in listed.join(done.select(F.col(by).cast("string").alias("sample")).distinct(), "sample", "left_anti").collect())


def replayed_files(spark: SparkSession, folder: str, schema: str, by: str, plan: DataFrame, done: DataFrame) -> DataFrame:
    """replayed() over a folder of sample files: files of samples that done has are not opened."""
    fresh = new_files(spark, folder, done, by)
    return done.unionByName(computed(spark.read.schema(schema).parquet(*fresh), by, plan)) if fresh else done
