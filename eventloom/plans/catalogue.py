"""Registered queries of the reference-parity operators: each a DataFrame plan, with the same in DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bridge, fitstats, gates, metadata, models, peaktrack, samples, series, timeqc
from ..operators.ranking import indexed, quantiles
from .views import BINNED, BINS, CYTO, DAY, FLAGS, PULSE, SEGMENTS, cyto_events, pulse_events, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
METRICS = ("rate", "dna_a_median", "dna_a_iqr")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, places: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# ---------------------------------------------------------------- statistics


@query(f"""WITH {CYTO} SELECT sample_id, count(*) AS n, round(avg(dna_a), 6) AS mean, round(stddev_pop(dna_a), 6) AS sd, round(quantile_cont(dna_a, 0.5), 6) AS median,
 round(min(dna_a), 6) AS min, round(max(dna_a), 6) AS max FROM cyto WHERE isfinite(dna_a) AND dna_a >= 0 GROUP BY 1""")
def column_stats(spark, d):
    return samples.column_stats(cyto_events(spark, d), "sample_id", "dna_a").select("sample_id", "n", *[_r(c).alias(c) for c in ("mean", "sd", "median", "min", "max")])


@query(f"""WITH {PULSE} SELECT sample_id, """ + ", ".join(f"round(avg({c}), 6) AS \"{c}:mean\", round(quantile_cont({c}, 0.5), 6) AS \"{c}:median\"" for c in ("dna_a", "dna_h", "fsc_a")) + """ FROM pulse GROUP BY 1""")
def stats_wide(spark, d):
    stats = samples.channel_stats(pulse_events(spark, d), "sample_id", ["dna_a", "dna_h", "fsc_a"])
    return samples.stats_wide(stats.select("sample_id", "channel", _r("mean").alias("mean"), _r("median").alias("median")), "sample_id", "channel", ("mean", "median"))


@query(f"""WITH {CYTO} SELECT sample_id, p, round(q, 6) AS q FROM (SELECT sample_id, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS p, unnest(quantile_cont(dna_a, [0.25, 0.5, 0.75])) AS q FROM cyto GROUP BY 1)""")
def quantile_linear(spark, d):
    return quantiles(cyto_events(spark, d), "sample_id", "dna_a", [0.25, 0.5, 0.75]).select("sample_id", "p", _r("q").alias("q"))


@query(f"""WITH {CYTO}, r AS (SELECT sample_id, dna_a, row_number() OVER (PARTITION BY sample_id ORDER BY dna_a) - 1 AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM cyto)
 SELECT sample_id, p::DOUBLE AS p, round(dna_a, 6) AS q FROM r, (SELECT unnest([0.005, 0.995]) AS p) WHERE k = floor((n - 1) * p::DOUBLE + 0.5)""")
def quantile_nearest_rank(spark, d):
    return quantiles(cyto_events(spark, d), "sample_id", "dna_a", [0.005, 0.995], nearest_rank=True).select("sample_id", "p", _r("q").alias("q"))


@query(f"""WITH {CYTO}, m AS (SELECT sample_id, quantile_cont(dna_a, 0.5) AS median FROM cyto GROUP BY 1)
 SELECT sample_id, round(median, 6) AS median, round(quantile_cont(abs(dna_a - median), 0.5), 6) AS mad, round(1.4826 * quantile_cont(abs(dna_a - median), 0.5), 5) AS robust_sd FROM cyto JOIN m USING (sample_id) GROUP BY sample_id, median""")
def mad_robust_scale(spark, d):
    return samples.spread(cyto_events(spark, d), "sample_id", "dna_a").select("sample_id", _r("median").alias("median"), _r("mad").alias("mad"), _r("robust_sd", 5).alias("robust_sd"))


@query(f"""WITH {CYTO}, m AS (SELECT sample_id, quantile_cont(dna_a, 0.5) AS med FROM cyto GROUP BY 1),
 s AS (SELECT sample_id, med, 1.4826 * quantile_cont(abs(dna_a - med), 0.5) AS sc FROM cyto JOIN m USING (sample_id) GROUP BY 1, 2)
 SELECT sample_id, count(*) FILTER (abs((dna_a - med) / sc) > 2) AS outliers, count(*) AS n FROM cyto JOIN s USING (sample_id) GROUP BY 1""")
def robust_z(spark, d):
    events = cyto_events(spark, d)
    z = events.join(samples.spread(events, "sample_id", "dna_a"), "sample_id").withColumn("z", C.robust_z(F.col("dna_a"), F.col("median"), F.col("robust_sd")))
    return z.groupBy("sample_id").agg(F.count_if(F.abs("z") > 2).alias("outliers"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- masks and funnels

_MASKS = "(dna_a >= 0 AND dna_a < 90000 AND dna_h >= 0 AND fsc_a >= 0) AS m1, (dna_h < 45) AS m2, (ssc_a > 0.01) AS m3"


def _masked(spark, d):
    return pulse_events(spark, d).withColumns({"m1": samples.structural_mask({"dna_a": 90000.0, "dna_h": None, "fsc_a": None}), "m2": F.col("dna_h") < 45, "m3": F.col("ssc_a") > 0.01})


@query(f"""WITH {PULSE} SELECT sample_id, count(*) AS n, count(*) FILTER (dna_a < 90000) AS kept FROM pulse GROUP BY 1""")
def structural_mask(spark, d):
    return _masked(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("m1").alias("kept"))


@query(f"""WITH {PULSE}, f AS (SELECT sample_id, {_MASKS} FROM pulse), c AS (SELECT sample_id, count(*) AS n, count(*) FILTER (m1) AS a, count(*) FILTER (m1 AND m2) AS b, count(*) FILTER (m1 AND m2 AND m3) AS c FROM f GROUP BY 1)
 SELECT sample_id, 1 AS step, 'structural' AS name, n AS entered, n - a AS lost FROM c UNION ALL SELECT sample_id, 2, 'pulse', a, a - b FROM c UNION ALL SELECT sample_id, 3, 'scatter', b, b - c FROM c""")
def filter_funnel(spark, d):
    return samples.funnel(_masked(spark, d), "sample_id", {"structural": F.col("m1"), "pulse": F.col("m2"), "scatter": F.col("m3")})


@query(f"""WITH {PULSE}, k AS (SELECT sample_id, CASE WHEN NOT dna_h < 45 THEN 'not_retained' WHEN dna_a < 0 THEN 'negative' WHEN dna_a >= 60000 THEN 'saturated' END AS class FROM pulse)
 SELECT sample_id, coalesce(class, 'eligible') AS class, count(*) AS n FROM k GROUP BY ALL""")
def eligible_dna_rejections(spark, d):
    k = samples.rejection_class(F.col("dna_a"), F.col("dna_h") < 45, 60000.0)
    return pulse_events(spark, d).groupBy("sample_id", F.coalesce(k, F.lit("eligible")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- histograms


def _hist_sql(lo: str, hi: str, x: str = "dna_a", where: str = "true", bins: int = 64) -> str:
    return f"""WITH {CYTO}, e AS (SELECT sample_id, {lo} AS a, {hi} AS b FROM (SELECT sample_id, {x} AS x FROM cyto WHERE {where}) GROUP BY 1), g AS (SELECT * FROM e, generate_series(0, {bins - 1}) t(bin)),
 c AS (SELECT sample_id, least(floor((({x}) - a) / ((b - a) / {bins})), {bins - 1})::BIGINT AS bin, count(*) AS count FROM cyto JOIN e USING (sample_id) WHERE {where} AND ({x}) >= a AND ({x}) <= b GROUP BY ALL)
 SELECT sample_id, bin, coalesce(count, 0) AS count, round(a + bin * ((b - a) / {bins}), 6) AS "left" FROM g LEFT JOIN c USING (sample_id, bin)"""


def _hist(h):
    return h.select("sample_id", "bin", "count", _r("left").alias("left"))


@query(_hist_sql("min(x)", "max(x)"))
def histogram_fixed(spark, d):
    return _hist(samples.histogram(cyto_events(spark, d), "sample_id", "dna_a", 64))


@query(_hist_sql("(SELECT min(dna_a) FROM cyto)", "(SELECT max(dna_a) FROM cyto)"))
def histogram_shared_range(spark, d):
    return _hist(samples.histogram(cyto_events(spark, d), "sample_id", "dna_a", 64, shared=True))


@query(_hist_sql("min(x)", "max(x)", "log10(dna_a)", "dna_a > 0"))
def histogram_log(spark, d):
    return _hist(samples.histogram(cyto_events(spark, d), "sample_id", "dna_a", 64, log=True))


@query(f"""WITH {CYTO} SELECT sample_id, count(*) FILTER (dna_a < 10) AS underflow, count(*) FILTER (dna_a > 100) AS overflow, count(*) FILTER (dna_a BETWEEN 10 AND 100) AS in_range FROM cyto GROUP BY 1""")
def clipping_counts(spark, d):
    return samples.clipping(cyto_events(spark, d), "sample_id", "dna_a", 10.0, 100.0)


@query(f"""WITH {CYTO}, n AS (SELECT min(n) AS worst FROM (SELECT count(*) AS n FROM cyto GROUP BY sample_id)) SELECT worst, CASE WHEN worst >= 51200 THEN 1024 WHEN worst >= 25600 THEN 512 WHEN worst >= 12800 THEN 256 ELSE 128 END AS bins FROM n""")
def recommended_bins(spark, d):
    return samples.recommended_bins(cyto_events(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- acquisition time


def _segmented(spark, d):
    return timeqc.segments(cyto_events(spark, d), "sample_id", "event_index", "time", DAY, blocks=True)


def _binned(spark, d):
    return timeqc.equal_count_bins(_segmented(spark, d), "sample_id", "event_index")


def _bins(spark, d):
    return timeqc.bin_summary(_binned(spark, d), "sample_id", "event_index", "unwrapped", ["dna_a"])


def _flags(spark, d):
    return timeqc.flagged_bins(_bins(spark, d), "sample_id", METRICS, limit=1.5)


@query(f"WITH {SEGMENTS} SELECT sample_id, segment::BIGINT AS segment, count(*) AS n, min(event_index) AS first, max(event_index) AS last FROM seg GROUP BY ALL")
def time_segments(spark, d):
    return _segmented(spark, d).groupBy("sample_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("event_index").alias("first"), F.max("event_index").alias("last"))


@query(f"WITH {SEGMENTS} SELECT sample_id, event_index, round(unwrapped, 6) AS unwrapped FROM seg")
def time_unwrapped(spark, d):
    return _segmented(spark, d).select("sample_id", "event_index", _r("unwrapped").alias("unwrapped"))


@query(f"WITH {BINNED} SELECT sample_id, segment::BIGINT AS segment, bin::BIGINT AS bin, count(*) AS n, min(event_index) AS first FROM binned GROUP BY ALL")
def equal_count_bins(spark, d):
    return _binned(spark, d).groupBy("sample_id", "segment", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("event_index").alias("first"))


@query(f"WITH {BINS} SELECT sample_id, segment::BIGINT AS segment, bin::BIGINT AS bin, n, round(rate, 6) AS rate, round(dna_a_median, 6) AS dna_a_median, round(dna_a_iqr, 6) AS dna_a_iqr FROM bins")
def bin_channel_summary(spark, d):
    return _bins(spark, d).select("sample_id", "segment", "bin", "n", _r("rate").alias("rate"), _r("dna_a_median").alias("dna_a_median"), _r("dna_a_iqr").alias("dna_a_iqr"))


@query(f"WITH {FLAGS} SELECT sample_id, metric, round(median, 6) AS median, round(scale, 5) AS scale FROM base")
def time_qc_baselines(spark, d):
    return timeqc.metric_baselines(_bins(spark, d), "sample_id", METRICS).select("sample_id", "metric", _r("median").alias("median"), _r("scale", 5).alias("scale"))


@query(f"WITH {FLAGS} SELECT sample_id, segment::BIGINT AS segment, bin::BIGINT AS bin, array_to_string(reasons, ',') AS reasons FROM flags WHERE len(reasons) > 0")
def time_qc_flags(spark, d):
    return _flags(spark, d).where("flagged").select("sample_id", "segment", "bin", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {FLAGS}, i AS (SELECT *, bin - row_number() OVER (PARTITION BY sample_id, segment ORDER BY bin) AS island FROM flags WHERE len(reasons) > 0)
 SELECT sample_id, segment::BIGINT AS segment, min(bin)::BIGINT AS first_bin, max(bin)::BIGINT AS last_bin, min(first) AS first, max(last) AS last, array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') AS reasons FROM i GROUP BY sample_id, segment, island""")
def time_qc_intervals(spark, d):
    return timeqc.intervals(_flags(spark, d), "sample_id", F.col("flagged")).select("sample_id", "segment", "first_bin", "last_bin", "first", "last", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {FLAGS} SELECT sample_id, count(*) AS n, count(*) FILTER (len(reasons) = 0) AS kept FROM binned JOIN flags USING (sample_id, segment, bin) GROUP BY 1")
def time_qc_retained(spark, d):
    return timeqc.retained(_binned(spark, d), _flags(spark, d), "sample_id").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("time_ok").alias("kept"))


@query(f"""WITH {SEGMENTS}, n AS (SELECT sample_id, segment, count(*) AS n FROM seg GROUP BY ALL), k AS (SELECT *, greatest(0, ceil((n - 150) / 75.0))::BIGINT AS k FROM n),
 t AS (SELECT *, CASE WHEN k > 0 AND n - k * 75 < 75 THEN k - 1 ELSE k END AS top FROM k), b AS (SELECT sample_id, segment, n, top, unnest(generate_series(0, top)) AS bin FROM t)
 SELECT sample_id, segment::BIGINT AS segment, bin::BIGINT AS bin, (CASE WHEN bin = top THEN n ELSE least(bin * 75 + 150, n) END - bin * 75)::BIGINT AS n FROM b""")
def overlapping_bins(spark, d):
    return timeqc.overlapping_bins(_segmented(spark, d), "sample_id", "event_index", 150).groupBy("sample_id", "segment", "bin").agg(F.count(F.lit(1)).alias("n"))


_RUNS = f"{BINS}, g AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY segment, bin) AS bin, dna_a_median, dna_a_median > avg(dna_a_median) OVER (PARTITION BY sample_id) AS good FROM bins)"


def _good(spark, d):
    w = Window.partitionBy("sample_id")
    return _bins(spark, d).select("sample_id", F.row_number().over(w.orderBy("segment", "bin")).alias("bin"), "dna_a_median", (F.col("dna_a_median") > F.avg("dna_a_median").over(w)).alias("good"))


@query(f"""WITH {_RUNS}, i AS (SELECT *, bin - sum(good::INT) OVER (PARTITION BY sample_id ORDER BY bin) AS island, min(bin) OVER (PARTITION BY sample_id) AS lo, max(bin) OVER (PARTITION BY sample_id) AS hi FROM g),
 r AS (SELECT sample_id, island, count(*) AS n, min(bin) AS a, max(bin) AS b FROM i WHERE good GROUP BY ALL)
 SELECT i.sample_id, i.bin::INT AS bin, coalesce(good AND (r.n >= 2 OR r.a = lo OR r.b = hi), false) AS kept FROM i LEFT JOIN r ON i.sample_id = r.sample_id AND i.island = r.island""")
def short_run_removal(spark, d):
    return timeqc.without_short_runs(_good(spark, d), "sample_id", "good", least=2).select("sample_id", "bin", "kept")


@query(f"WITH {_RUNS}, i AS (SELECT *, bin - row_number() OVER (PARTITION BY sample_id ORDER BY bin) AS island FROM g WHERE good), r AS (SELECT sample_id, count(*) AS n FROM i GROUP BY sample_id, island) SELECT sample_id, max(n) AS longest FROM r GROUP BY 1")
def longest_run(spark, d):
    return timeqc.longest_run(_good(spark, d), "sample_id", "good")


@query(f"WITH {_RUNS} SELECT sample_id, bin::INT AS bin, round(avg(dna_a_median) OVER (PARTITION BY sample_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM g")
def moving_mean5(spark, d):
    return timeqc.moving_mean(_good(spark, d), "sample_id", "dna_a_median").select("sample_id", "bin", _r("smooth").alias("smooth"))


# ---------------------------------------------------------------- the sample table


@query("""WITH r AS (SELECT doc_id AS ord, lower(trim(source)) AS key FROM documents), f AS (SELECT key, min(ord) AS file FROM (SELECT c_custkey AS ord, 'src' || (c_custkey % 25) AS key FROM customer) GROUP BY 1),
 k AS (SELECT r.*, f.file AS found, row_number() OVER (PARTITION BY r.key ORDER BY ord) AS rank FROM r LEFT JOIN f USING (key)), l AS (SELECT ord, CASE WHEN found IS NULL THEN 'unmatched' WHEN rank > 1 THEN 'duplicate' ELSE 'matched' END AS link, found FROM k)
 SELECT ord, link, CASE WHEN link = 'matched' THEN found END AS file FROM l""")
def meta_link_join(spark, d):
    records = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), C.filename_key(F.col("source")).alias("key"))
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.concat(F.lit("src"), F.col("c_custkey") % 25).alias("key"))
    return metadata.linked(records, files, "key", "ord", "n").select("ord", "link", "file")


@query("""SELECT d.doc_id, coalesce(l.quality::VARCHAR, d.lang, '') AS lang FROM documents d LEFT JOIN labels l USING (doc_id)""")
def annotation_overlay(spark, d):
    saved = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("lang"))
    return metadata.overlaid(table(spark, d, "documents").select("doc_id", "lang"), saved, "doc_id", ["lang"])


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src10')")
def in_filter_multi(spark, d):
    return metadata.filtered(table(spark, d, "documents").select("doc_id", "lang", "source"), {"lang": ["en", "de"], "source": ["src1", "src2", "src10"], "doc_id": []})


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_visible_semi(spark, d):
    chosen = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return metadata.filtered(table(spark, d, "documents").select("doc_id", "lang"), {"lang": ["en"]}).join(chosen, "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT source, row_number() OVER (ORDER BY substr(source, 1, 3), substr(source, 4)::INT) AS rank FROM (SELECT DISTINCT source FROM documents)")
def natural_sort_rank(spark, d):
    names = metadata.distinct_values(table(spark, d, "documents"), "source")
    return names.select("source", F.row_number().over(Window.orderBy(*metadata.sort_keys("source", "source"))).alias("rank"))  # a row per distinct name


@query("SELECT doc_id, source, NULL::VARCHAR AS role, NULL::BIGINT AS conv_id FROM documents UNION ALL SELECT NULL, NULL, role, conv_id FROM conversations")
def union_outer(spark, d):
    return metadata.union_outer(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "conversations").select("role", "conv_id"))


@query("SELECT c_name, split_part(c_name, '#', 1) AS prefix, CASE WHEN instr(c_name, '#') > 0 THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS number FROM customer")
def filename_split_delim(spark, d):
    return metadata.with_split(table(spark, d, "customer").select("c_name"), "c_name", [("delimiter", "#")], ["prefix", "number"])


@query("SELECT p_type, CASE WHEN length(p_type) > 3 THEN substr(p_type, 1, 3) ELSE p_type END AS a, CASE WHEN length(p_type) > 3 THEN substr(p_type, 4) ELSE '' END AS b FROM part")
def filename_split_fixed(spark, d):
    return metadata.with_split(table(spark, d, "part").select("p_type"), "p_type", [("fixed", 3)], ["a", "b"])


@query("SELECT url, CASE WHEN regexp_matches(url, '//([^/]+)/') THEN regexp_extract(url, '//([^/]+)/', 1) ELSE url END AS host FROM pages")
def filename_split_regex(spark, d):
    return metadata.with_split(table(spark, d, "pages").select("url"), "url", [("regex", "//([^/]+)/")], ["host"])


@query("SELECT url, lower(trim(list_last(string_split(url, '/')))) AS key FROM pages")
def filename_key(spark, d):
    return table(spark, d, "pages").select("url", C.filename_key(F.col("url")).alias("key"))


@query(r"SELECT c_name, try_cast(nullif(regexp_extract(c_name, '([-+]?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS timepoint FROM customer")
def timepoint_from_name(spark, d):
    return table(spark, d, "customer").select("c_name", C.first_decimal(F.col("c_name")).alias("timepoint"))


@query("SELECT s_suppkey, CASE WHEN t LIKE '-%' THEN '''' || t ELSE t END AS cell FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '' END || s_name AS t FROM supplier)")
def tsv_safe_cell(spark, d):
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "-").otherwise(""), F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", C.tsv_cell(text).alias("cell"))


# ---------------------------------------------------------------- geometry and diagnostics


@query(f"""WITH {PULSE} SELECT sample_id, count(*) AS n, round(avg(dna_a), 4) AS mean_x, round(avg(dna_h), 6) AS mean_y, round(covar_pop(dna_a, dna_h), 2) AS xy, round(0.5 * atan2(2 * covar_pop(dna_a, dna_h), var_pop(dna_a) - var_pop(dna_h)), 8) AS angle FROM pulse GROUP BY 1""")
def covariance2d(spark, d):
    return samples.covariance(pulse_events(spark, d), "sample_id", "dna_a", "dna_h").select("sample_id", "n", _r("mean_x", 4).alias("mean_x"), _r("mean_y").alias("mean_y"), _r("xy", 2).alias("xy"), _r("angle", 8).alias("angle"))


@query(f"""WITH {PULSE}, d AS (SELECT sample_id, ((dna_h - 25) * (dna_h - 25) / 200 + (ssc_a - 0.04) * (ssc_a - 0.04) / 0.0006) AS d2 FROM pulse) SELECT sample_id, count(*) FILTER (d2 <= 5.991) AS inside, count(*) AS n FROM d GROUP BY 1""")
def mahalanobis_gate_apply(spark, d):
    d2 = C.mahalanobis(F.col("dna_h"), F.col("ssc_a"), (25.0, 0.04), (200.0, 0.0, 0.0006))
    return pulse_events(spark, d).withColumn("d2", d2).groupBy("sample_id").agg(F.count_if(F.col("d2") <= 5.991).alias("inside"), F.count(F.lit(1)).alias("n"))


_FIT = _hist_sql("min(x)", "max(x)").replace("SELECT sample_id, bin, coalesce(count, 0) AS count, round", ", h AS (SELECT sample_id, bin, coalesce(count, 0)::DOUBLE AS y, round").replace("FROM g LEFT JOIN c USING (sample_id, bin)", "FROM g LEFT JOIN c USING (sample_id, bin)), f AS (SELECT *, avg(y) OVER (PARTITION BY sample_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 0.5 AS mu FROM h)").replace(")\n , h AS", "),\n h AS")


def _fitted(spark, d):
    h = samples.histogram(cyto_events(spark, d), "sample_id", "dna_a", 64).select("sample_id", "bin", F.col("count").cast("double").alias("y"))
    return h.withColumn("mu", F.avg("y").over(Window.partitionBy("sample_id").orderBy("bin").rowsBetween(-3, 3)) + 0.5)


@query(_FIT + """ SELECT sample_id, round(sum((y - mu) * (y - mu)), 4) AS sse, round(sum((y - mu) * (y - mu) / mu), 6) AS chi2, round(sum(2 * CASE WHEN y > 0 THEN y * ln(y / mu) - (y - mu) ELSE mu END), 6) AS deviance,
 round(sum(2 * CASE WHEN y > 0 THEN y * ln(y / mu) - (y - mu) ELSE mu END) + 18, 6) AS aic, round(sum(2 * CASE WHEN y > 0 THEN y * ln(y / mu) - (y - mu) ELSE mu END) + 9 * ln(count(*)), 6) AS bic FROM f GROUP BY 1""")
def gof_table(spark, d):
    return fitstats.goodness(_fitted(spark, d), "sample_id", "y", "mu", 9).select("sample_id", _r("sse", 4).alias("sse"), *[_r(c).alias(c) for c in ("chi2", "deviance", "aic", "bic")])


@query(_FIT + """, r AS (SELECT sample_id, bin, (y - mu) / sqrt(mu) AS r FROM f), rc AS (SELECT *, r - avg(r) OVER (PARTITION BY sample_id) AS c FROM r), l AS (SELECT *, lag(c) OVER w AS p, r - lag(r) OVER w AS d FROM rc WINDOW w AS (PARTITION BY sample_id ORDER BY bin))
 SELECT sample_id, round(sum(c * p) / sum(c * c), 6) AS lag1, round(sum(d * d) / sum(r * r), 6) AS durbin_watson FROM l GROUP BY 1""")
def residual_structure(spark, d):
    f = _fitted(spark, d).withColumn("r", C.pearson_residual(F.col("y"), F.col("mu")))
    return fitstats.residual_structure(f, "sample_id", "bin", "r").select("sample_id", _r("lag1").alias("lag1"), _r("durbin_watson").alias("durbin_watson"))


@query(_FIT + """, s AS (SELECT sample_id, bin, sign(y - mu) AS s FROM f WHERE y <> mu), t AS (SELECT *, (s <> lag(s) OVER (PARTITION BY sample_id ORDER BY bin))::INT AS turn FROM s),
 k AS (SELECT sample_id, (count(*) FILTER (s > 0))::DOUBLE AS a, (count(*) FILTER (s < 0))::DOUBLE AS b, coalesce(sum(turn), 0) + 1 AS runs FROM t GROUP BY 1)
 SELECT sample_id, round((runs - (2 * a * b / (a + b) + 1)) / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1))), 6) AS runs_z FROM k""")
def runs_test_z(spark, d):
    f = _fitted(spark, d).withColumn("r", F.col("y") - F.col("mu"))
    return fitstats.residual_structure(f, "sample_id", "bin", "r").select("sample_id", _r("runs_z").alias("runs_z"))


@query(_FIT + """, m AS (SELECT sample_id, bin, avg(y - mu) OVER w AS m, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)),
 mid AS (SELECT sample_id, median(y - mu) AS c FROM f GROUP BY 1), sc AS (SELECT sample_id, greatest(1.4826 * median(abs(y - mu - c)), 1e-12) AS scale FROM f JOIN mid USING (sample_id) GROUP BY 1)
 SELECT sample_id, round(max(abs(m)) / any_value(scale), 6) AS bias FROM m JOIN sc USING (sample_id) WHERE n = 11 GROUP BY 1""")
def local_bias(spark, d):
    f = _fitted(spark, d).withColumn("r", F.col("y") - F.col("mu"))
    return fitstats.local_bias(f, "sample_id", "bin", "r").select("sample_id", _r("bias").alias("bias"))


@query(_FIT + " SELECT sample_id, round(sum(y), 4) AS total, round(sum(bin * y) / sum(y), 6) AS mean, round(sqrt(sum(bin * bin * y) / sum(y) - pow(sum(bin * y) / sum(y), 2)), 6) AS sd FROM f GROUP BY 1")
def component_moments(spark, d):
    return fitstats.component_moments(_fitted(spark, d), "sample_id", "bin", "y").select("sample_id", _r("total", 4).alias("total"), _r("mean").alias("mean"), _r("sd").alias("sd"))


@query(_FIT + ", t AS (SELECT sample_id, (y + lag(y) OVER (PARTITION BY sample_id ORDER BY bin)) / 2 AS a FROM f) SELECT sample_id, round(sum(a), 4) AS area FROM t GROUP BY 1")
def trapezoid_area(spark, d):
    return fitstats.trapezoid(_fitted(spark, d), "sample_id", "bin", "y").select("sample_id", _r("area", 4).alias("area"))


@query(_FIT + """, j AS (SELECT sample_id, bin, y, CASE WHEN y = lag(y) OVER w THEN 0 ELSE 1 END AS j FROM f WINDOW w AS (PARTITION BY sample_id ORDER BY bin)),
 i AS (SELECT *, sum(j) OVER (PARTITION BY sample_id ORDER BY bin) AS i FROM j), r AS (SELECT sample_id, i, any_value(y) AS y, min(bin) AS a, max(bin) AS b FROM i GROUP BY 1, 2),
 n AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q, max(b) OVER (PARTITION BY sample_id) AS z FROM r WINDOW w AS (PARTITION BY sample_id ORDER BY i)), k AS (SELECT sample_id, (a + b) // 2 + 1 AS x, y FROM n WHERE y > p AND (q IS NULL OR y > q) AND a < z),
 s AS (SELECT a.sample_id, a.x AS x1, b.x AS x2, b.x / a.x AS ratio, sqrt(a.y * b.y) * exp(-0.5 * pow((b.x / a.x - 2.0) / 0.08, 2)) AS score FROM k a JOIN k b ON a.sample_id = b.sample_id AND b.x > a.x AND b.x / a.x BETWEEN 1.8 AND 2.1)
 SELECT sample_id, x1, x2, round(score, 6) AS score FROM s""")
def candidate_peak_pairs(spark, d):
    peaks = fitstats.local_maxima(_fitted(spark, d), "sample_id", "bin", "y").withColumn("x", F.col("bin") + 1)
    return fitstats.peak_pairs(peaks, "sample_id", "x", "y").select("sample_id", "x1", "x2", _r("score").alias("score"))


_PULSE_SCORE = "SELECT sample_id, '{0}' AS channel, 1 + 0.25 * abs(sum((dna_a - a) * ({0} - b)) / sqrt(sum((dna_a - a) * (dna_a - a)) * sum(({0} - b) * ({0} - b)))) + 0.05 * avg((dna_a > 0 AND {0} > 0)::INT) + {1} AS score FROM pulse JOIN (SELECT sample_id, median(dna_a) AS a, median({0}) AS b FROM pulse GROUP BY 1) USING (sample_id) GROUP BY 1"


@query(f"WITH {PULSE}, e AS ({_PULSE_SCORE.format('dna_h', '1e-6')} UNION ALL {_PULSE_SCORE.format('fsc_a', '0')}) SELECT sample_id, arg_max(channel, score) AS channel, round(max(score), 6) AS score FROM e GROUP BY 1")
def pulse_channel_choice(spark, d):
    return gates.pulse_channel_choice(pulse_events(spark, d), "sample_id", "dna_a", "dna_h", "fsc_a").select("sample_id", "channel", _r("score").alias("score"))


_ERF = "(CASE WHEN {0} < 0 THEN -1 ELSE 1 END) * (1 - ((((1.061405429 * (1 / (1 + 0.3275911 * abs({0}))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({0}))) + 1.421413741) * (1 / (1 + 0.3275911 * abs({0}))) - 0.284496736) * (1 / (1 + 0.3275911 * abs({0}))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({0}))) * exp(-({0}) * ({0})))"


@query(f"SELECT l_linenumber, l_quantity, round(1000 * (0.5 * (1 + {_ERF.format('((l_quantity + 1 - 25) / 7.0 / sqrt(2.0))')}) - 0.5 * (1 + {_ERF.format('((l_quantity - 25) / 7.0 / sqrt(2.0))')})), 8) AS mass FROM (SELECT DISTINCT l_linenumber, l_quantity FROM lineitem)")
def gaussian_bin_mass(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_linenumber", "l_quantity").distinct().select("l_linenumber", "l_quantity", _r(C.gaussian_mass(q, q + 1, 1000.0, 25.0, 7.0), 8).alias("mass"))


# ---------------------------------------------------------------- numerical operators: no SQL expresses them


@query()
def gmm_gate(spark, d):
    events = pulse_events(spark, d)
    fits = gates.fit_scatter(events, "sample_id", "dna_a", "dna_h")
    return gates.apply_scatter(events, fits, "sample_id", "dna_a", "dna_h").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("scatter_ok").alias("kept"))


@query()
def ridge_fit(spark, d):
    events = pulse_events(spark, d)
    fits = gates.fit_singlets(events, "sample_id", "dna_a", "dna_w")
    return gates.apply_singlets(events, fits, "sample_id", "dna_a", "dna_w").groupBy("sample_id", F.col("singlet_status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if("singlet_ok").alias("kept")).select("sample_id", "n", "kept", "status")


def _arrays(spark, d):
    return models.arrays(samples.histogram(cyto_events(spark, d), "sample_id", "dna_a", 128), "sample_id")


@query()
def multiscale_peaks(spark, d):
    return models.detected_peaks(_arrays(spark, d), "sample_id")


@query()
def fit_dean_jett(spark, d):
    h = _arrays(spark, d)
    return models.fitted(h, models.detected_peaks(h, "sample_id"), "sample_id", "dean_jett")


@query()
def fit_watson_pragmatic(spark, d):
    h = _arrays(spark, d)
    return models.fitted(h, models.detected_peaks(h, "sample_id"), "sample_id", "watson_pragmatic")


@query()
def result_contract(spark, d):
    h = _arrays(spark, d)
    return fitstats.reportable(models.fitted(h, models.detected_peaks(h, "sample_id"), "sample_id", "dean_jett")).select("sample_id", "model", "converged", "valid")


@query()
def peak_tracking_qc(spark, d):
    binned = timeqc.overlapping_bins(_segmented(spark, d), "sample_id", "event_index", 150)
    flags = peaktrack.flagged_bins(binned, "sample_id", "event_index", "unwrapped", "dna_a")
    return peaktrack.retained(binned, flags, "sample_id", "event_index").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("time_ok").alias("kept"))


# ---------------------------------------------------------------- more of the relational operators


@query(f"WITH {CYTO} SELECT sample_id, round(quantile_cont(dna_a, 0.75) - quantile_cont(dna_a, 0.25), 6) AS iqr FROM cyto GROUP BY 1")
def iqr_by_group(spark, d):
    q = quantiles(cyto_events(spark, d), "sample_id", "dna_a", [0.25, 0.75])
    return q.groupBy("sample_id").agg(_r(F.max("q") - F.min("q")).alias("iqr"))


@query(f"WITH {BINS} SELECT sample_id, segment::BIGINT AS segment, bin::BIGINT AS bin, round(rate, 6) AS rate FROM bins")
def bin_event_rate(spark, d):
    return _bins(spark, d).select("sample_id", "segment", "bin", _r("rate").alias("rate"))


@query("""WITH t AS (SELECT doc_id AS ord, lang AS key, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS file FROM documents), a AS (SELECT 'en' AS key, -1 AS nf UNION ALL SELECT 'de', -2),
 r AS (SELECT *, sum(CASE WHEN file IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ord) AS k FROM t) SELECT ord, coalesce(file, CASE WHEN k = 1 THEN nf END)::BIGINT AS file FROM r LEFT JOIN a USING (key)""")
def late_link(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("key"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("file"))
    arrived = spark.sql("SELECT * FROM VALUES ('en', -1L), ('de', -2L) t(key, new_file)")
    return metadata.late_linked(rows, arrived, "key", "ord").select("ord", "file")


@query(r"SELECT c_custkey, row_number() OVER (ORDER BY coalesce(try_cast(nullif(regexp_extract(t, '^\s*([-+]?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE), 1e308), c_custkey) AS rank FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'late' ELSE (c_custkey % 50)::VARCHAR || ' h' END AS t FROM customer)")
def timepoint_sort_rank(spark, d):
    t = F.when(F.col("c_custkey") % 7 == 0, "late").otherwise(F.concat((F.col("c_custkey") % 50).cast("string"), F.lit(" h")))
    rows = table(spark, d, "customer").select("c_custkey", C.leading_number(t).alias("number"))
    counts = rows.groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("number", (F.sum("n").over(Window.orderBy("number")) - F.col("n")).alias("before"))  # a row per distinct number
    return indexed(rows, "number", "c_custkey", "k").join(before, "number").select("c_custkey", (F.col("before") + F.col("k") + 1).cast("int").alias("rank"))


@query("SELECT c_mktsegment, c_custkey, k - 1 AS alternative FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k BETWEEN 2 AND 4")
def top_k_alternatives(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("k", F.row_number().over(w)).where("k BETWEEN 2 AND 4").select("c_mktsegment", "c_custkey", (F.col("k") - 1).alias("alternative"))


@query(f"WITH {CYTO} SELECT sample_id, event_index FROM cyto WHERE dna_a >= 20 EXCEPT SELECT sample_id, event_index FROM cyto WHERE dna_a >= 60")
def mask_difference(spark, d):
    events = cyto_events(spark, d)
    return events.where("dna_a >= 20").select("sample_id", "event_index").exceptAll(events.where("dna_a >= 60").select("sample_id", "event_index"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'SSC_A' ELSE 'FSC_A,SSC_A' END AS missing FROM supplier")
def array_except_channels(spark, d):
    have = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("DNA_A"), F.lit("FSC_A"))).otherwise(F.array(F.lit("DNA_A")))
    wanted = F.array(F.lit("DNA_A"), F.lit("FSC_A"), F.lit("SSC_A"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.array_except(wanted, have), ",").alias("missing"))


@query("SELECT p_partkey, ['a', 'h', 'w', NULL][(p_partkey % 4 + 1)::INT] AS kind, 'fl' || (p_partkey % 3) || CASE WHEN p_partkey % 4 = 3 THEN '-x' ELSE '' END AS base FROM part")
def measurement_kind(spark, d):
    ends = F.element_at(F.array(F.lit("Area"), F.lit("HEIGHT"), F.lit("width"), F.lit("x")), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("FL"), (F.col("p_partkey") % 3).cast("string"), F.lit(" - "), ends)
    return table(spark, d, "part").select("p_partkey", C.measurement_kind(name).alias("kind"), C.measurement_base(name).alias("base"))


@query(_FIT + " SELECT sample_id, bin, round(2 * CASE WHEN y > 0 THEN y * ln(y / mu) - (y - mu) ELSE mu END, 6) AS deviance, round((y - mu) / sqrt(mu), 6) AS pearson FROM f")
def poisson_residuals(spark, d):
    return _fitted(spark, d).select("sample_id", "bin", _r(C.poisson_deviance(F.col("y"), F.col("mu"))).alias("deviance"), _r(C.pearson_residual(F.col("y"), F.col("mu"))).alias("pearson"))


@query("""WITH f AS (SELECT c_nationkey AS sample, c_mktsegment AS model, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY ALL)
 SELECT sample, """ + ", ".join(f"max(v) FILTER (model = '{m}') AS \"{m}\"" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM f GROUP BY sample")
def phase_fractions_pivot(spark, d):
    f = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("sample"), F.col("c_mktsegment").alias("model")).agg(_r(F.avg("c_acctbal"), 4).alias("v"))
    return f.groupBy("sample").pivot("model", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).agg(F.max("v"))


@query("SELECT p_brand AS fingerprint, count(*) AS samples, round(quantile_cont(p_retailprice / 1000.0, 0.5), 6) AS centre FROM part GROUP BY 1 HAVING count(*) >= 2")
def shared_regions_median(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("fingerprint"), (F.col("p_retailprice") / 1000.0).alias("x"))
    n = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("samples")).where("samples >= 2")
    return n.join(quantiles(rows, "fingerprint", "x", [0.5]), "fingerprint").select("fingerprint", "samples", _r("q").alias("centre"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'degraded' ELSE 'failed' END"


@query(f"SELECT CASE {_STATUS} WHEN 'applied' THEN 'success' WHEN 'degraded' THEN 'warning' ELSE 'failed' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def qc_outcome_classes(spark, d):
    status = F.expr(_STATUS)
    return table(spark, d, "orders").groupBy(fitstats.qc_outcome(F.lit(True), F.lit(False), status).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PULSE} SELECT sample_id, count(*) FILTER (abs((dna_h - 25) * 0.8 - (dna_a / 1000 - 38) * 0.6) <= 5) AS kept, count(*) AS n FROM pulse GROUP BY 1")
def ridge_apply(spark, d):
    line = {"mx": 38000.0, "sx": 1000.0, "my": 25.0, "sy": 1.0, "cx": 0.0, "cy": 0.0, "dx": 0.8, "dy": 0.6}
    rows = pulse_events(spark, d).withColumns({k: F.lit(v) for k, v in line.items()})
    return rows.withColumn("far", F.abs(gates.ridge_distance(F.col("dna_a"), F.col("dna_h")))).groupBy("sample_id").agg(F.count_if(F.col("far") <= 5).alias("kept"), F.count(F.lit(1)).alias("n"))


def _model(name):
    def run(spark, d):
        h = _arrays(spark, d)
        return models.fitted(h, models.detected_peaks(h, "sample_id"), "sample_id", name)

    return run


for _name in ("dean_jett_fox", "watson_classic", *(n for n in models.MODELS if n in (bridge.bridge.__name__, bridge.bridge_extended.__name__))):
    QUERIES[f"fit_{_name}"] = _model(_name)
QUERIES["auto_select"] = _model("auto")


@query()
def cloccs_series(spark, d):
    h = models.arrays(samples.histogram(cyto_events(spark, d), "sample_id", "dna_a", 32, shared=True), "sample_id")
    minute = F.row_number().over(Window.orderBy("sample_id")) * 30.0 - 30.0  # a row per sample
    series_ = h.withColumns({"strain": F.lit("one"), "minute": minute})
    return series.fitted_series(series_, "strain", "minute", (30.0, 30.0, 8.0))
