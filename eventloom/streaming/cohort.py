"""Statistics of samples as files arrive: a stream of event files, folded batch by batch into one row per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import is_finite


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Events of Parquet files that appear under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_stats(events: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, population deviance, minimum and maximum of finite values from zero up, kept by sample."""
    x = F.when(is_finite(F.col(value)) & (F.col(value) >= 0), F.col(value))
    return events.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))


def windowed_counts(events: DataFrame, by: str, time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by sample and window of arrival time; windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("window.start").alias("start"), "n")


def keep_stats(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the stats after each batch under path, replacing what was there; a restart goes on from the checkpoint."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id % 2}")

    return stats.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(store).start()
