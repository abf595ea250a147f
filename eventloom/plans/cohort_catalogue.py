"""Registered queries of channels, cohort review and text columns, with the same in DuckDB SQL; importing it adds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import channels, cohort
from .catalogue import _bins, _flags, _r, query
from .views import BINS, CYTO, FLAGS, cyto_events, table

PARAMS = """params AS (SELECT p_size AS file, p_partkey AS index, CASE p_partkey % 9 WHEN 0 THEN 'FSC-A' WHEN 1 THEN 'SSC Area' WHEN 2 THEN 'Time' WHEN 3 THEN 'HDR-T' WHEN 4 THEN 'Event Time' ELSE 'FL' || (p_partkey % 4) || ['-A', ' Height', '-W'][(p_partkey % 3 + 1)::INT] END AS name FROM part)"""


def _params(spark, d):
    k = F.col("p_partkey")
    ends = F.element_at(F.array(F.lit("-A"), F.lit(" Height"), F.lit("-W")), (k % 3 + 1).cast("int"))
    name = F.when(k % 9 == 0, "FSC-A").when(k % 9 == 1, "SSC Area").when(k % 9 == 2, "Time").when(k % 9 == 3, "HDR-T").when(k % 9 == 4, "Event Time").otherwise(F.concat(F.lit("FL"), (k % 4).cast("string"), ends))
    return table(spark, d, "part").select(F.col("p_size").alias("file"), k.alias("index"), name.alias("name"))


@query(f"""WITH {PARAMS}, k AS (SELECT *, CASE WHEN name LIKE '%-A' OR name LIKE '%Area' THEN 'a' WHEN name LIKE '%Height' THEN 'h' WHEN name LIKE '%-W' THEN 'w' END AS kind, lower(regexp_replace(name, '(-A|-W| Height| Area)$', '')) AS base FROM params),
 c AS (SELECT file, base, kind, min(index) AS i FROM k WHERE kind IN ('h', 'w') GROUP BY ALL)
 SELECT k.file, k.index, h.i AS h, w.i AS w FROM k LEFT JOIN c h ON h.file = k.file AND h.base = k.base AND h.kind = 'h' LEFT JOIN c w ON w.file = k.file AND w.base = k.base AND w.kind = 'w' WHERE k.kind = 'a'""")
def companion_channels(spark, d):
    return channels.companions(_params(spark, d))


@query(f"""WITH {PARAMS} SELECT file, min(index) FILTER (name = 'FSC-A') AS fsc_a, min(index) FILTER (name = 'SSC Area') AS ssc_a, coalesce(min(index) FILTER (name IN ('Time', 'HDR-T')), min(index) FILTER (name = 'Event Time')) AS time FROM params GROUP BY file""")
def canonical_channels(spark, d):
    return channels.canonical(_params(spark, d))


@query(f"WITH {PARAMS} SELECT file, index, CASE WHEN index % 5 = 0 THEN name WHEN index % 5 = 1 THEN NULL ELSE 'Other' END AS companion FROM params")
def companion_override(spark, d):
    override = F.when(F.col("index") % 5 == 1, "").when(F.col("index") % 5 != 0, "Other")
    return _params(spark, d).select("file", "index", channels.overridden(F.col("name"), override).alias("companion"))


@query(f"WITH {PARAMS} SELECT file, arg_min(name, index) AS name FROM params WHERE name LIKE 'FL%' OR name IN ('Time', 'Event Time') GROUP BY file")
def column_suggestion(spark, d):
    return channels.suggested(_params(spark, d), ("fl", "TIME"))


@query(f"WITH {PARAMS}, f AS (SELECT name, min((file, index)) AS met FROM params GROUP BY name) SELECT name, row_number() OVER (ORDER BY met) AS place FROM f")
def distinct_label_union(spark, d):
    return channels.label_union(_params(spark, d), "file")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS duplicate FROM orders")
def file_load_dedupe(spark, d):
    return channels.unique_files(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "duplicate")


REGIONS = "r AS (SELECT p_partkey, p_brand, 100.0::DOUBLE + p_size AS range, 10.0 + p_size / 10.0 AS g1_left, 14.0 + p_size / 7.0 AS g1_right, 30.0 + p_retailprice / 1000.0 AS g2_left, 36.0 + p_size / 9.0 AS g2_right FROM part)"


def _regions(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", "p_brand", (100.0 + size).alias("range"), (10.0 + size / 10.0).alias("g1_left"), (14.0 + size / 7.0).alias("g1_right"), (30.0 + price / 1000.0).alias("g2_left"), (36.0 + size / 9.0).alias("g2_right"))


@query(f"""WITH {REGIONS}, m AS (SELECT p_brand, count(*) AS samples, arg_min(range, p_partkey) AS range, quantile_cont((g1_left + g1_right) / (2 * range), 0.5) AS c1, quantile_cont((g1_right - g1_left) / range, 0.5) AS w1,
 quantile_cont((g2_left + g2_right) / (2 * range), 0.5) AS c2, quantile_cont((g2_right - g2_left) / range, 0.5) AS w2 FROM r GROUP BY p_brand HAVING count(*) >= 2),
 e AS (SELECT p_brand, samples, (c1 - w1 / 2) * range AS a, (c1 + w1 / 2) * range AS b, (c2 - w2 / 2) * range AS c, (c2 + w2 / 2) * range AS d FROM m)
 SELECT p_brand, samples, round(a, 6) AS g1_left, round(b, 6) AS g1_right, round(c, 6) AS g2_left, round(d, 6) AS g2_right FROM e WHERE a < b AND b <= c AND c < d""")
def shared_regions(spark, d):
    return cohort.shared_regions(_regions(spark, d), "p_brand", "p_partkey").select("p_brand", "samples", *[_r(c).alias(c) for c in ("g1_left", "g1_right", "g2_left", "g2_right")])


@query("""SELECT p_partkey, array_to_string(list_distinct(list_concat(CASE WHEN l1 >= r1 THEN ['g1_left', 'g1_right'] ELSE [] END, CASE WHEN l2 >= r2 THEN ['g2_left', 'g2_right'] ELSE [] END, CASE WHEN r1 > l2 THEN ['g1_right', 'g2_left'] ELSE [] END)).list_sort(), ',') AS invalid
 FROM (SELECT p_partkey, (p_partkey % 7)::DOUBLE AS l1, 4.0 AS r1, (p_partkey % 5)::DOUBLE AS l2, (p_partkey % 3 * 3)::DOUBLE AS r2 FROM part)""")
def region_draft_validation(spark, d):
    k = F.col("p_partkey")
    regions = F.struct((k % 7).cast("double").alias("g1_left"), F.lit(4.0).alias("g1_right"), (k % 5).cast("double").alias("g2_left"), (k % 3 * 3).cast("double").alias("g2_right"))
    return table(spark, d, "part").withColumn("r", regions).select("p_partkey", F.array_join(F.array_sort(cohort.invalid_region_keys(F.col("r"))), ",").alias("invalid"))


_OUTCOME = "['converged_reportable', 'computed_nonconverged', 'detection_failed', 'fit_failed', 'cancelled', 'skipped']"


@query(f"WITH s AS (SELECT {_OUTCOME}[(o_orderkey % 6 + 1)::INT] AS s FROM orders) SELECT count(*) AS attempted, count(*) FILTER (s = 'converged_reportable') AS success, count(*) FILTER (s IN ('computed_nonconverged', 'detection_failed', 'fit_failed')) AS failed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'cancelled') AS cancelled FROM s")
def bulk_outcome_counts(spark, d):
    names = F.expr("array" + _OUTCOME.replace("[", "(").replace("]", ")"))
    return cohort.bulk_outcomes(table(spark, d, "orders").select(F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("s")), "s")


@query(f"WITH {FLAGS} SELECT sample_id, reason, count(*) AS n FROM (SELECT sample_id, unnest(reasons) AS reason FROM flags) GROUP BY ALL")
def reason_counts(spark, d):
    return cohort.reason_counts(_flags(spark, d), "sample_id", "reasons")


@query(f"""WITH {FLAGS}, t AS (SELECT *, (len(reasons) > 0)::INT AS f FROM flags), u AS (SELECT *, f * (1 - coalesce(lag(f) OVER (PARTITION BY sample_id ORDER BY first), 0)) AS fresh FROM t),
 s AS (SELECT sample_id, sum(n)::BIGINT AS entered, sum(f * n)::BIGINT AS removed, sum(fresh)::BIGINT AS regions FROM u GROUP BY sample_id)
 SELECT *, round(100.0 * removed / entered, 6) AS percent, CASE WHEN 100.0 * removed / entered > 50 THEN 'critical' WHEN 100.0 * removed / entered > 20 THEN 'high' ELSE 'normal' END AS level FROM s""")
def time_qc_cohort_summary(spark, d):
    return cohort.time_summary(_flags(spark, d), "sample_id", "n", "reasons").withColumn("percent", _r("percent"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 AND l_quantity > 25 THEN 'failed' WHEN l_quantity > 45 THEN 'degraded' ELSE 'applied' END AS status, 1000 - 10 * l_linenumber AS entered, 990 - 10 * l_linenumber AS left_ FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),
 g AS (SELECT l_orderkey, arg_min(entered, l_linenumber) AS total, coalesce(arg_min(status, l_linenumber) FILTER (status <> 'applied'), 'Complete') AS status, arg_max(left_, l_linenumber) AS l FROM s GROUP BY 1)
 SELECT l_orderkey, total::INT AS total, status, (total - l)::INT AS lost, round(100.0 * (total - l) / total, 6) AS percent FROM g""")
def qc_result_columns(spark, d):
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity"))["l_quantity"].alias("l_quantity"))
    stages = rows.select("l_orderkey", "l_linenumber", F.when((line % 3 == 0) & (quantity > 25), "failed").when(quantity > 45, "degraded").otherwise("applied").alias("status"), (1000 - 10 * line).cast("int").alias("entered"), (990 - 10 * line).cast("int").alias("left"))
    return cohort.qc_columns(stages, "l_orderkey", "l_linenumber", "status", "entered", "left").withColumn("percent", _r("percent"))


@query("""WITH s AS (SELECT l_suppkey AS k, l_quantity::DOUBLE AS v, l_extendedprice::DOUBLE AS o FROM lineitem), b AS (SELECT *, min(o) OVER (PARTITION BY k) AS best FROM s)
 SELECT k, count(*) AS starts, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(stddev_pop(v) / abs(avg(v)), 6) AS cv, round(avg((o <= best + 0.01 * (abs(best) + 1))::INT), 6) AS agreement FROM b GROUP BY k""")
def start_dispersion(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("double").alias("v"), F.col("l_extendedprice").cast("double").alias("o"))
    return cohort.start_dispersion(s, "k", "v", "o").withColumns({c: _r(c) for c in ("mean", "cv", "agreement")})


@query(f"""WITH {BINS}, t AS (SELECT sample_id, abs(n - lag(n) OVER (PARTITION BY sample_id ORDER BY first)) AS step FROM bins) SELECT sample_id, round(greatest(1, coalesce(quantile_cont(step, 0.5) / 0.954, 1)), 6) AS noise FROM t GROUP BY sample_id""")
def noise_floor(spark, d):
    return cohort.noise_floor(_bins(spark, d), "sample_id", "first", "n").withColumn("noise", _r("noise"))


@query(f"WITH {CYTO}, r AS (SELECT sample_id, min(dna_a) AS a, max(dna_a) AS b FROM cyto GROUP BY 1) SELECT round(min(a), 6) AS low, round(max(b), 6) AS high FROM r")
def visible_range_union(spark, d):
    per = cyto_events(spark, d).groupBy("sample_id").agg(F.min("dna_a").alias("a"), F.max("dna_a").alias("b"))
    return cohort.visible_range(per, "a", "b", override=(5.0, 5.0)).select(_r("low").alias("low"), _r("high").alias("high"))


@query(f"WITH {CYTO}, n AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM cyto) SELECT sample_id, event_index FROM n WHERE event_index % greatest(1, n // 100) = 0")
def stride_sampling(spark, d):
    return cohort.strided(cyto_events(spark, d), "sample_id", "event_index", most=100).select("sample_id", "event_index")


@query(f"WITH {CYTO} SELECT sample_id, arg_min(event_index, (abs(dna_a - 50), event_index)) AS event_index FROM cyto GROUP BY sample_id")
def nearest_index(spark, d):
    return cohort.nearest_index(cyto_events(spark, d), "sample_id", "event_index", "dna_a", 50.0)


@query(f"WITH {CYTO} SELECT sample_id, event_index, CASE WHEN dna_a >= 10 AND dna_a < 90 THEN floor((dna_a - 10) / 5)::BIGINT END AS bin FROM cyto")
def point_in_bin(spark, d):
    return cyto_events(spark, d).select("sample_id", "event_index", cohort.point_bin(F.col("dna_a"), 10.0, 5.0, 16).alias("bin"))


@query(f"WITH {CYTO} SELECT count(DISTINCT sample_id) AS samples, count(*) AS events FROM cyto")
def cohort_title_totals(spark, d):
    return cohort.cohort_totals(cyto_events(spark, d), "sample_id")


@query("SELECT p_brand, CASE WHEN t > 1 THEN floor(k * 360 / t + 0.5)::BIGINT % 360 ELSE 210 END AS hue FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS k, count(*) OVER () AS t FROM (SELECT DISTINCT p_brand FROM part))")
def sample_colours(spark, d):
    return cohort.sample_hues(table(spark, d, "part"), "p_brand")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE 'wt' END AS strain, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 't' || (p_partkey % 60) END AS replicate, CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE '' END AS arrest, (p_partkey % 60)::VARCHAR AS timepoint FROM part")
def filename_annotation_guess(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("plate_"), F.col("p_size").cast("string"), F.lit("aN t"), (k % 60).cast("string"), F.lit("_x.fcs"))).otherwise(F.concat(F.lit("plate wt t"), (k % 60).cast("string"), F.lit(".fcs")))
    return table(spark, d, "part").select("p_partkey", T.guessed_annotations(name).alias("g")).select("p_partkey", "g.*")


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def filename_timestamp(spark, d):
    return table(spark, d, "events").select("event_id", T.filename_timestamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM documents""")
def html_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.html_escaped(F.col("text")).alias("html"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '-' ELSE printf('%.1f', p_size / 60.0 * 100) END AS percent FROM part")
def number_formatting(spark, d):
    return table(spark, d, "part").select("p_partkey", T.percent_text(F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 60.0)).alias("percent"))


@query("SELECT p_partkey, list_reduce([2166136261::HUGEINT, p_size::HUGEINT, (p_partkey % 2)::HUGEINT, 1::HUGEINT], lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS hash FROM part")
def mask_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", T.fnv1a(F.array(F.col("p_size").cast("long"), (F.col("p_partkey") % 2).cast("long"), F.lit(1).cast("long"))).alias("hash"))


@query("SELECT p_partkey, (p_size + p_size + 3.0) / 2 AS first_centre, CASE WHEN p_size > 3 THEN 1 ELSE 0 END::BIGINT AS least, round(p_size * 0.75::DOUBLE, 6) AS step FROM part")
def array_helpers(spark, d):
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.get(T.bin_centres(F.array(size, size + 3.0, size + 5.0)), 0).alias("first_centre"), T.arg_min(F.array(size, F.lit(3.0), F.lit(60.0))).alias("least"), _r(F.get(T.linspace(F.lit(0.0), size, 5), 3)).alias("step"))
