"""Views that read the generic tables as cohorts of events, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import indexed

DAY = 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cyto_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples by type: sample_id, event_index, dna_a, time (seconds of the day, a timer that wraps)."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("sample_id"), "event_id", F.col("value").alias("dna_a"), (F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000)) / 1e6).alias("time"))
    return indexed(rows, "sample_id", "event_id", "event_index").drop("event_id")


def pulse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as events of several channels; dna_w follows dna_a."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sample_id"), F.col("l_extendedprice").alias("dna_a"), F.col("l_quantity").alias("dna_h"), F.col("l_discount").alias("fsc_a"), F.col("l_tax").alias("ssc_a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("dna_w"))


CYTO = """cyto AS (SELECT event_type AS sample_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS event_index,
  value AS dna_a, (epoch_us(ts) % 86400000000) / 1e6 AS time FROM events)"""
PULSE = """pulse AS (SELECT l_returnflag AS sample_id, l_extendedprice AS dna_a, l_quantity AS dna_h, l_discount AS fsc_a, l_tax AS ssc_a FROM lineitem)"""
SEGMENTS = f"""{CYTO}, s1 AS (SELECT *, lag(time) OVER (PARTITION BY sample_id ORDER BY event_index) AS p FROM cyto),
 s2 AS (SELECT *, coalesce(time < p - 1e-6, false) AS back, coalesce(time < p - 1e-6, false) AND p > 0.8 * {DAY} AND time < 0.2 * {DAY} AS wrap FROM s1),
 s3 AS (SELECT *, CASE WHEN p IS NULL OR (back AND NOT wrap) THEN 1 ELSE 0 END AS fresh FROM s2),
 s4 AS (SELECT *, sum(fresh) OVER (PARTITION BY sample_id ORDER BY event_index) - 1 AS segment FROM s3),
 s5 AS (SELECT *, time + {DAY} * sum(CASE WHEN fresh = 1 OR NOT wrap THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id, segment ORDER BY event_index) AS u FROM s4),
 seg AS (SELECT sample_id, event_index, dna_a, time, segment, max(u) OVER (PARTITION BY sample_id, segment ORDER BY event_index) AS unwrapped FROM s5)"""
BINNED = SEGMENTS + """, b1 AS (SELECT *, count(*) OVER (PARTITION BY sample_id, segment) AS n_, row_number() OVER (PARTITION BY sample_id, segment ORDER BY event_index) - 1 AS r_ FROM seg),
 b2 AS (SELECT *, greatest(1, floor(n_ / 500.0 + 0.5))::BIGINT AS k_ FROM b1),
 binned AS (SELECT sample_id, event_index, dna_a, unwrapped, segment, ((r_ + 1) * k_ - 1) // n_ AS bin FROM b2)"""
BINS = BINNED + """, bins0 AS (SELECT sample_id, segment, bin, count(*) AS n, min(event_index) AS first, max(event_index) AS last,
   arg_max(unwrapped, event_index) - arg_min(unwrapped, event_index) AS dt, quantile_cont(dna_a, 0.5) AS dna_a_median, quantile_cont(dna_a, 0.75) - quantile_cont(dna_a, 0.25) AS dna_a_iqr
   FROM binned GROUP BY ALL),
 bins AS (SELECT sample_id, segment, bin, n, first, last, CASE WHEN dt > 0 AND n > 1 THEN (n - 1) / dt END AS rate, dna_a_median, dna_a_iqr FROM bins0)"""
FLAGS = BINS + """, long AS (SELECT sample_id, segment, bin, unnest(['rate','dna_a_median','dna_a_iqr']) AS metric, unnest([rate, dna_a_median, dna_a_iqr]) AS x FROM bins),
 med AS (SELECT sample_id, metric, quantile_cont(x, 0.5) AS median FROM long WHERE x IS NOT NULL GROUP BY ALL),
 base AS (SELECT l.sample_id, l.metric, m.median, 1.4826 * quantile_cont(abs(x - m.median), 0.5) AS scale FROM long l JOIN med m USING (sample_id, metric) WHERE x IS NOT NULL GROUP BY ALL),
 over_ AS (SELECT sample_id, segment, bin, list_sort(list(metric)) AS reasons FROM long JOIN base USING (sample_id, metric)
   WHERE x IS NOT NULL AND CASE WHEN scale > 0 THEN abs(x - median) / scale ELSE CASE WHEN x = median THEN 0 ELSE 1e300 END END > 1.5 GROUP BY ALL),
 flags AS (SELECT b.*, CASE WHEN count(*) OVER (PARTITION BY sample_id) >= 3 THEN coalesce(o.reasons, []) ELSE [] END AS reasons FROM bins b LEFT JOIN over_ o USING (sample_id, segment, bin))"""
