"""Registered queries of whole runs: files to events, filters with failures, replayed statistics, calibration and fits of a cohort."""

from __future__ import annotations

import posixpath

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration, preflight, qcrun, regions, samples, statsplan
from ..operators.cohort import can_share
from ..operators.qcrun import Filter
from ..sources import fcs, session
from ..sources.scratch import scratch
from .catalogue import _r, query
from .cohort_catalogue import REGIONS, _regions
from .views import CYTO, PULSE, cyto_events, pulse_events, table

# ---------------------------------------------------------------- files


def _broken(batches):
    """Beside each file three that can't be read: cut short, of another version, and without a whole header."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, inner = pyarrow.fs.FileSystem.from_uri(path)
            base, name = posixpath.split(inner)
            with fs.open_input_file(inner) as f:
                raw = f.read(min(f.size() - 5, 1 << 20))
            for kind, data in (("short", raw), ("version", b"XYZ" + raw[3:]), ("head", raw[:30])):
                with fs.open_output_stream(f"{base}/{kind}_{name}") as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])


@query(f"""WITH {CYTO} SELECT sample_id AS name, count(*) AS n, round(sum(dna_a), 4) AS total, max(event_index) AS last, NULL::VARCHAR AS code FROM cyto GROUP BY 1
 UNION ALL SELECT kind || '_' || sample_id, NULL, NULL, NULL, code FROM (SELECT DISTINCT sample_id FROM cyto), (VALUES ('short', 'FCS_DATA_TRUNCATED'), ('version', 'FCS_VERSION_UNSUPPORTED'), ('head', 'FCS_HEADER_TRUNCATED')) v(kind, code)""")
def fcs_quarantine(spark, d):
    """Event files of every sample are written, three broken ones beside each, and the folder is read."""
    folder = scratch(spark, "fcs")
    fcs.write_events(cyto_events(spark, d), "sample_id", "event_index", ["dna_a", "time"], folder).select("path").mapInArrow(_broken, "path string").count()
    events, errors = fcs.load_events(spark, folder)
    good = events.groupBy(F.col("sample_id").alias("name")).agg(F.count(F.lit(1)).alias("n"), _r(F.sum("dna_a"), 4).alias("total"), F.max("event_index").alias("last"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.fcs$", "")
    return good.unionByName(errors.select(name.alias("name"), "code"), allowMissingColumns=True)


# ---------------------------------------------------------------- runs of filters

LOTS = """lots AS (SELECT l_suppkey AS sample_id, l_extendedprice::DOUBLE AS dna_a, l_quantity::DOUBLE AS dna_h, l_discount::DOUBLE AS fsc_a, l_tax::DOUBLE AS ssc_a,
  CASE WHEN s_suppkey % 5 > 0 THEN 40000.0 + s_suppkey % 50 * 1000 END AS top FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _lots(spark, d):
    """lineitem as events of a sample per supplier, with the sample's own ceiling."""
    number = lambda c, n: F.col(c).cast("double").alias(n)
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), number("l_extendedprice", "dna_a"), number("l_quantity", "dna_h"), number("l_discount", "fsc_a"), number("l_tax", "ssc_a"))
    k = F.col("s_suppkey")
    files = table(spark, d, "supplier").select(k.alias("sample_id"), F.when(k % 5 > 0, 40000.0 + k % 50 * 1000).alias("top"))
    return lines.join(qcrun.ceilings(files, "sample_id", {"dna_a": "top", "dna_h": "top"}, {"dna_h": {"enabled": False}}), "sample_id")


def _filters():
    return [
        Filter("structural", samples.structural_mask({"dna_a": F.col("ceiling_dna_a"), "dna_h": F.col("ceiling_dna_h")}), {"NO_EVENTS": lambda kept: F.count_if(kept) > 0}),
        Filter("pulse", F.col("dna_h") < 45, {"HEIGHT_OUT_OF_RANGE": lambda kept: F.avg(F.when(kept, F.col("dna_h"))) <= 25.5}),
        Filter("scatter", F.col("ssc_a") > 0.01, {"SCATTER_TOO_LOW": lambda kept: qcrun.mean_at_least(F.when(kept, F.col("fsc_a")), "0.0499")}),
    ]


def _run_sql(go_on: bool) -> str:
    return f"""WITH {LOTS}, e1 AS (SELECT *, dna_a >= 0 AND coalesce(dna_a < top, true) AND dna_h >= 0 AS k1 FROM lots),
 s1 AS (SELECT sample_id, count(*) AS n0, count(*) FILTER (k1) AS n1, coalesce(avg(dna_h) FILTER (k1) <= 25.5, false) AS ok2 FROM e1 GROUP BY 1),
 e2 AS (SELECT e1.*, n0, n1, ok2, k1 AND (NOT ok2 OR dna_h < 45) AS k2 FROM e1 JOIN s1 USING (sample_id)),
 s2 AS (SELECT sample_id, count(*) FILTER (k2) AS n2, coalesce(avg(fsc_a) FILTER (k2) >= 0.0499, false) AS good3 FROM e2 GROUP BY 1),
 e3 AS (SELECT e2.*, n2, {"true" if go_on else "ok2"} AS ran3, good3 AND {"true" if go_on else "ok2"} AS ok3 FROM e2 JOIN s2 USING (sample_id)),
 e4 AS (SELECT *, k2 AND (NOT ok3 OR ssc_a > 0.01) AS k3 FROM e3),
 s3 AS (SELECT sample_id, n0, n1, ok2, n2, ran3, ok3, count(*) FILTER (k3) AS n3 FROM e4 GROUP BY ALL),
 steps AS (SELECT sample_id, 1 AS step, 'structural' AS name, 'applied' AS status, NULL AS code, n0 AS entered, n1 AS kept FROM s3
  UNION ALL SELECT sample_id, 2, 'pulse', CASE WHEN ok2 THEN 'applied' ELSE 'failed' END, CASE WHEN NOT ok2 THEN 'HEIGHT_OUT_OF_RANGE' END, n1, n2 FROM s3
  UNION ALL SELECT sample_id, 3, 'scatter', CASE WHEN ok3 THEN 'applied' WHEN ran3 THEN 'failed' ELSE 'not_run' END, CASE WHEN ran3 AND NOT ok3 THEN 'SCATTER_TOO_LOW' END, n2, n3 FROM s3)"""


@query(_run_sql(True) + " SELECT * FROM steps")
def qc_run(spark, d):
    return qcrun.run(_lots(spark, d), "sample_id", _filters(), go_on=True)[1]


@query(_run_sql(False) + " SELECT * FROM steps")
def qc_run_until_failure(spark, d):
    return qcrun.run(_lots(spark, d), "sample_id", _filters())[1]


@query(_run_sql(False) + """, k AS (SELECT sample_id, dna_a FROM e4 WHERE k3), r AS (SELECT min(dna_a) AS a, max(dna_a) AS b FROM k), g AS (SELECT DISTINCT sample_id, bin FROM k, generate_series(0, 15) t(bin)),
 c AS (SELECT sample_id, least(floor((dna_a - a) / ((b - a) / 16)), 15)::BIGINT AS bin, count(*) AS n FROM k, r GROUP BY ALL) SELECT sample_id, bin, coalesce(n, 0) AS count FROM g LEFT JOIN c USING (sample_id, bin)""")
def qc_run_histogram(spark, d):
    """What a run keeps, as histograms over the range that all samples share."""
    events, _ = qcrun.run(_lots(spark, d), "sample_id", _filters())
    return samples.histogram(events.where("kept"), "sample_id", "dna_a", 16, shared=True).select("sample_id", "bin", "count")


@query(_run_sql(True) + """ SELECT sample_id, CASE WHEN count(*) FILTER (status <> 'applied') > 0 THEN 'incomplete' ELSE 'complete' END AS status, coalesce(string_agg(name, ',' ORDER BY step) FILTER (status <> 'applied'), '') AS failed,
 arg_min(entered, step) - arg_max(kept, step) AS lost, round(100.0 * (arg_min(entered, step) - arg_max(kept, step)) / arg_min(entered, step), 6) AS percent FROM steps GROUP BY 1""")
def qc_completion(spark, d):
    steps = qcrun.run(_lots(spark, d), "sample_id", _filters(), go_on=True)[1]
    return qcrun.completion(steps, "sample_id").withColumns({"failed": F.array_join("failed", ","), "percent": _r("percent")})


@query(_run_sql(True) + """, w AS (SELECT s_suppkey AS sample_id, 'pulse' AS name, CASE s_suppkey % 3 WHEN 0 THEN 'noisy' ELSE '  ' END AS reason FROM supplier),
 o AS (SELECT s.sample_id, s.name, s.status, s.code, CASE WHEN trim(w.reason) <> '' THEN w.reason END AS waiver FROM steps s LEFT JOIN w ON w.sample_id = s.sample_id AND w.name = s.name WHERE s.status <> 'applied')
 SELECT *, bool_and(waiver IS NOT NULL) OVER (PARTITION BY sample_id) AS approved FROM o""")
def qc_waivers(spark, d):
    steps = qcrun.run(_lots(spark, d), "sample_id", _filters(), go_on=True)[1]
    waivers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.lit("pulse").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "noisy").otherwise("  ").alias("reason"))
    return calibration.waived(steps, waivers, "sample_id")


# ---------------------------------------------------------------- statistics again


@query(f"""WITH {PULSE}, x AS (SELECT *, dna_h < 25 AS low FROM pulse) SELECT sample_id, 'dna_a' AS channel, '' AS mask, unnest(['n', 'mean', 'median']) AS metric, unnest([count(dna_a)::DOUBLE, round(avg(dna_a), 4), round(quantile_cont(dna_a, 0.5), 4)]) AS value FROM x GROUP BY 1
 UNION ALL SELECT sample_id, 'dna_h', 'low', unnest(['n', 'max', 'median']), unnest([count(dna_h)::DOUBLE, max(dna_h), quantile_cont(dna_h, 0.5)]) FROM x WHERE low GROUP BY 1""")
def stats_plan_replay(spark, d):
    """A plan made on the first sample and replayed on those that come later."""
    events, masks = pulse_events(spark, d), {"low": F.col("dna_h") < 25}
    plan = statsplan.recorded(statsplan.plan_of_columns(spark, ["dna_a:n", "dna_a:mean", "id"]), "dna_a", ["median", "n"])
    plan = statsplan.recorded(plan, "dna_h", ["n", "max", "median"], "low")
    first = statsplan.computed(events.where("sample_id = 'A'"), "sample_id", plan, masks)
    return statsplan.replayed(events, "sample_id", plan, first, masks).withColumn("value", _r("value", 4))


# ---------------------------------------------------------------- calibration and fits

AXES = "axes AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'FL' || p_partkey % 3 END AS channel, CASE WHEN p_partkey % 10 > 0 THEN 1024.0 * (1 + p_partkey % 2) END AS range, CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE 'FL1,FL2' END AS spillover, p_type AS instrument FROM part)"


def _axis(channel=None):
    k = F.col("p_partkey")
    own = F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("FL"), (k % 3).cast("string")))
    return calibration.fingerprint({"channel": own if channel is None else channel, "range": F.when(k % 10 > 0, 1024.0 * (1 + k % 2)), "datatype": F.lit("F"), "bits": F.lit(32), "amplification": F.lit(""), "spillover": F.when(k % 9 > 0, "FL1,FL2"), "instrument": F.col("p_type")})


@query(f"WITH {AXES} SELECT channel, range, '0,0' AS amplification, spillover, instrument, count(*) AS samples, min(p_partkey) AS first FROM axes WHERE channel <> '' AND range IS NOT NULL GROUP BY ALL")
def calibration_classes(spark, d):
    found = calibration.classes(table(spark, d, "part").withColumn("axis", _axis()), "p_partkey", "axis")
    return found.select("axis.channel", "axis.range", "axis.amplification", "axis.spillover", "axis.instrument", "samples", "first")


_REVIEW = "CASE WHEN p_partkey % 7 = 0 THEN 'ambiguous' ELSE 'detected' END"
PROPOSALS = f"""{REGIONS}, {AXES}, p AS (SELECT r.*, CASE WHEN a.range IS NOT NULL THEN a.range::VARCHAR || a.spillover || a.instrument END AS axis, {_REVIEW} AS status, 0.5 + p_partkey % 10 / 20.0::DOUBLE AS confidence,
   list_distinct(list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'ambiguous' END, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 < 2 THEN 'ambiguous_alternatives' END, CASE WHEN p_partkey % 11 = 0 THEN 'inferred_region' END, CASE WHEN p_partkey % 23 = 0 THEN 'width_fallback' END], lambda x: x IS NOT NULL)) AS reasons,
   p_partkey % 13 > 0 AS found FROM r JOIN axes a USING (p_partkey))"""


def _proposals(spark, d):
    k, have = F.col("p_partkey"), F.col("p_partkey") % 13 > 0
    part = _regions(spark, d).join(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey")
    status = F.when(k % 7 == 0, "ambiguous").otherwise("detected")
    source = F.when(k % 11 == 0, "inferred").otherwise("detected")
    reasons = calibration.review_reasons(status, k % 3, (k % 5) / 20.0 - 0.0001, source, F.lit("detected"), k % 23 == 0)
    ends = {c: F.when(have, F.col(c)) for c in ("g1_left", "g1_right", "g2_left", "g2_right")}
    fit = F.when(k % 17 > 0, F.struct((k % 19 == 0).alias("cancelled"), (k % 5 > 0).alias("computed"), (k % 6 > 0).alias("valid"), (k % 4 > 0).alias("converged")))
    return part.withColumns({"axis": _axis(F.lit("FL1")), "status": status, "confidence": 0.5 + (k % 10) / 20.0, "reasons": reasons, "fit": fit} | ends)


@query("""SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_retailprice / 1500.0 >= 0.65 AND p_partkey % 4 > 0""")
def share_eligibility(spark, d):
    """Detections that may be shared: detected, sure enough, and nothing about them needs review."""
    rows, k = table(spark, d, "part"), F.col("p_partkey")
    status = F.when(F.col("p_size") % 3 == 0, "detected").otherwise("ambiguous")
    reasons = calibration.review_reasons(status, F.lit(0), F.lit(1.0), F.when(k % 4 == 0, "inferred").otherwise("detected"), F.lit("detected"), F.lit(False))
    return rows.where(can_share(status, F.col("p_retailprice") / 1500.0) & (F.size(reasons) == 0)).select("p_partkey")


@query(f"WITH {PROPOSALS} SELECT p_partkey, array_to_string(list_sort(reasons), ',') AS reasons FROM p")
def detection_review(spark, d):
    return _proposals(spark, d).select("p_partkey", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


_FIT_ALL = f"""WITH {PROPOSALS}, t AS (SELECT *, found AND len(reasons) = 0 AND status = 'detected' AND confidence >= 0.65 AND axis IS NOT NULL AS trusted FROM p),
 f AS (SELECT p_brand, arg_min(axis, p_partkey) AS reference FROM t WHERE trusted GROUP BY 1), i AS (SELECT t.*, coalesce(trusted AND axis = reference, false) AS included FROM t LEFT JOIN f USING (p_brand)),
 m AS (SELECT p_brand, arg_min(range, p_partkey) AS range, quantile_cont((g1_left + g1_right) / (2 * range), 0.5) AS c1, quantile_cont((g1_right - g1_left) / range, 0.5) AS w1, quantile_cont((g2_left + g2_right) / (2 * range), 0.5) AS c2, quantile_cont((g2_right - g2_left) / range, 0.5) AS w2 FROM i WHERE included GROUP BY 1 HAVING count(*) >= 2),
 s AS (SELECT * FROM (SELECT p_brand, (c1 - w1 / 2) * range AS a, (c1 + w1 / 2) * range AS b, (c2 - w2 / 2) * range AS c, (c2 + w2 / 2) * range AS d FROM m) WHERE a < b AND b <= c AND c < d),
 o AS (SELECT i.*, a, included AND a IS NOT NULL AS shared, CASE WHEN NOT found THEN ['detection_failed', 'no_peak_regions'] WHEN p_partkey % 17 = 0 THEN ['skipped', 'skipped'] WHEN p_partkey % 19 = 0 THEN ['cancelled', 'fit_cancelled'] WHEN p_partkey % 5 = 0 THEN ['fit_failed', 'no_valid_model']
   WHEN p_partkey % 6 = 0 THEN ['fit_failed', 'invalid_for_reporting'] WHEN p_partkey % 4 > 0 THEN ['converged_reportable', 'converged_reportable'] ELSE ['computed_nonconverged', 'nonconverged'] END AS oc FROM i LEFT JOIN s USING (p_brand))"""


@query(_FIT_ALL + " SELECT p_partkey, trusted, included, CASE WHEN shared THEN 'shared_median_normalized' ELSE 'independent' END AS mode, round(CASE WHEN shared THEN a WHEN found THEN g1_left END, 6) AS g1_left, oc[1] AS outcome, oc[2] AS why FROM o")
def fit_all_outcomes(spark, d):
    return calibration.fit_all(_proposals(spark, d), "p_brand", "p_partkey").select("p_partkey", "trusted", "included", "mode", _r("g1_left").alias("g1_left"), "outcome", "why")


@query(_FIT_ALL + " SELECT p_brand, count(*) AS attempted, count(*) FILTER (oc[1] = 'converged_reportable') AS success, count(*) FILTER (oc[1] IN ('computed_nonconverged', 'detection_failed', 'fit_failed')) AS failed, count(*) FILTER (oc[1] = 'skipped') AS skipped, count(*) FILTER (oc[1] = 'cancelled') AS cancelled, count(*) FILTER (shared) AS shared FROM o GROUP BY 1")
def fit_all_accounting(spark, d):
    return calibration.accounted(calibration.fit_all(_proposals(spark, d), "p_brand", "p_partkey"), "p_brand")


# ---------------------------------------------------------------- regions

BINNED64 = f"""WITH {CYTO}, e AS (SELECT sample_id, min(dna_a) AS lo, max(dna_a) AS hi FROM cyto GROUP BY 1), q AS (SELECT sample_id, bin, lo + bin * ((hi - lo) / 64) AS "left", lo + (bin + 1) * ((hi - lo) / 64) AS "right" FROM e, generate_series(0, 63) t(bin)),
 h AS (SELECT sample_id, least(floor((dna_a - lo) / ((hi - lo) / 64)), 63)::BIGINT AS bin, count(*) AS n FROM cyto JOIN e USING (sample_id) GROUP BY ALL), y AS (SELECT q.*, coalesce(n, 0)::DOUBLE AS y FROM q LEFT JOIN h USING (sample_id, bin)),
 b AS (SELECT y.sample_id, y.bin, y."left" AS l, y."right" AS r, (y."left" + y."right") / 2 AS c, sum(exp(-0.5 * pow((o.bin - y.bin) / 2.0, 2)) * o.y) / sum(exp(-0.5 * pow((o.bin - y.bin) / 2.0, 2))) AS v FROM y JOIN y o ON o.sample_id = y.sample_id AND abs(o.bin - y.bin) <= 8 GROUP BY ALL),
 nb AS (SELECT *, v > lag(v) OVER w AND v > lead(v) OVER w AS hill FROM b WINDOW w AS (PARTITION BY sample_id ORDER BY bin)),
 pk AS (SELECT sample_id, 'g1' AS g, coalesce(arg_min(bin, (-v, bin)) FILTER (hill AND bin < 24), 8) AS p FROM nb GROUP BY 1 UNION ALL SELECT sample_id, 'g2', coalesce(arg_min(bin, (-v, bin)) FILTER (hill AND bin >= 24), 32) FROM nb GROUP BY 1),
 m1 AS (SELECT sample_id, g, p, max(v) FILTER (bin = p) AS top, coalesce(min((v, bin)) FILTER (bin BETWEEN p - 24 AND p - 1), (max(v) FILTER (bin = p), p)) AS lb, coalesce(min((v, bin)) FILTER (bin BETWEEN p + 1 AND p + 24), (max(v) FILTER (bin = p), p)) AS rb FROM pk JOIN b USING (sample_id) GROUP BY sample_id, g, p),
 m2 AS (SELECT *, greatest(lb[1], rb[1]) AS base, top - 0.5 * greatest(0, top - greatest(lb[1], rb[1])) AS level FROM m1),
 m3 AS (SELECT m2.sample_id, g, p, top, base, level, max(bin) FILTER (v <= level AND bin <= p) AS a, min(bin) FILTER (v <= level AND bin >= p) AS z, sum(greatest(0, v - base)) FILTER (bin BETWEEN lb[2] AND rb[2]) AS area FROM m2 JOIN b USING (sample_id) GROUP BY ALL),
 m4 AS (SELECT m3.*, CASE WHEN a IS NULL THEN 0 WHEN a = p THEN p ELSE a + CASE WHEN abs(a2.v - a1.v) < 1e-12 THEN 0.5 ELSE greatest(0, least(1, (level - a1.v) / (a2.v - a1.v))) END END AS lc,
   CASE WHEN z IS NULL THEN 63 WHEN z = p THEN p ELSE z - CASE WHEN abs(z2.v - z1.v) < 1e-12 THEN 0.5 ELSE greatest(0, least(1, (level - z1.v) / (z2.v - z1.v))) END END AS rc
   FROM m3 LEFT JOIN b a1 ON a1.sample_id = m3.sample_id AND a1.bin = a LEFT JOIN b a2 ON a2.sample_id = m3.sample_id AND a2.bin = a + 1 LEFT JOIN b z1 ON z1.sample_id = m3.sample_id AND z1.bin = z LEFT JOIN b z2 ON z2.sample_id = m3.sample_id AND z2.bin = z - 1),
 mm AS (SELECT *, greatest(0.5, (p - lc) / sqrt(2 * ln(2))) AS sl, greatest(0.5, (rc - p) / sqrt(2 * ln(2))) AS sr FROM m4)"""


def _smooth(spark, d):
    h = samples.histogram(cyto_events(spark, d), "sample_id", "dna_a", 64)
    return regions.smoothed(h.select("sample_id", "bin", "left", "right", F.col("count").cast("double").alias("y")), "sample_id")


def _pairs(spark, d):
    """The highest local maximum below bin 24 and from it on; the upper one counts as found in samples whose name has an even length."""
    w = Window.partitionBy("sample_id").orderBy("bin")
    hills = _smooth(spark, d).withColumn("hill", (F.col("smooth") > F.lag("smooth").over(w)) & (F.col("smooth") > F.lead("smooth").over(w)))
    best = lambda inside, other: F.coalesce(F.min(F.when(F.col("hill") & inside, F.struct((-F.col("smooth")).alias("v"), "bin")))["bin"], F.lit(other).cast("long"))
    one = hills.groupBy("sample_id").agg(best(F.col("bin") < 24, 8).alias("g1"), best(F.col("bin") >= 24, 32).alias("g2"))
    return one.withColumns({"g1_found": F.lit(True), "g2_found": F.length("sample_id") % 2 == 0})


@query(BINNED64 + " SELECT sample_id, g, p::BIGINT AS peak, round(greatest(0, top - base), 4) AS prominence, round(lc, 4) AS left_crossing, round(rc, 4) AS right_crossing, round(sl, 4) AS sigma_left, round(sr, 4) AS sigma_right, round(area, 4) AS area FROM mm")
def peak_widths(spark, d):
    each = _pairs(spark, d).select("sample_id", F.inline(F.array(*[F.struct(F.lit(g).alias("g"), F.col(g).alias("peak")) for g in ("g1", "g2")])))
    found = regions.measured(_smooth(spark, d), each, "sample_id")
    return found.select("sample_id", "g", "peak", *[_r(c, 4).alias(c) for c in ("prominence", "left_crossing", "right_crossing", "sigma_left", "sigma_right", "area")])


_REGION_SQL = BINNED64 + """, w AS (SELECT sample_id, median(r - l) AS w, min(l) AS lo, max(r) AS hi FROM b GROUP BY 1),
 j AS (SELECT a.sample_id, w.*, ca.c AS c1, cz.c AS c2, a.sl AS s1, length(a.sample_id) % 2 = 0 AS found2, CASE WHEN length(a.sample_id) % 2 = 0 THEN z.sr ELSE a.sl END AS s2 FROM mm a JOIN mm z ON z.sample_id = a.sample_id AND a.g = 'g1' AND z.g = 'g2' JOIN w ON w.sample_id = a.sample_id
   JOIN b ca ON ca.sample_id = a.sample_id AND ca.bin = a.p JOIN b cz ON cz.sample_id = a.sample_id AND cz.bin = z.p),
 k AS (SELECT *, greatest(lo, least(hi, c1 - greatest(1.5 * w, 2.75 * s1 * w))) AS l1, greatest(lo, least(hi, c1 + greatest(1.5 * w, 1.5 * s1 * w))) AS r1, greatest(lo, least(hi, c2 - greatest(1.5 * w, 1.5 * s2 * w))) AS l2, greatest(lo, least(hi, c2 + greatest(1.5 * w, 2.75 * s2 * w))) AS r2, (c1 + c2) / 2 AS mid FROM j),
 region AS (SELECT sample_id, l1 AS g1_left, CASE WHEN r1 >= l2 THEN least(r1, mid) ELSE r1 END AS g1_right, CASE WHEN r1 >= l2 THEN greatest(l2, mid) ELSE l2 END AS g2_left, r2 AS g2_right, found2 FROM k)"""


@query(_REGION_SQL + " SELECT sample_id, round(g1_left, 4) AS g1_left, round(g1_right, 4) AS g1_right, round(g2_left, 4) AS g2_left, round(g2_right, 4) AS g2_right, CASE WHEN found2 THEN 'detected' ELSE 'inferred' END AS g2_source FROM region")
def region_proposal(spark, d):
    found = regions.proposed(_smooth(spark, d), _pairs(spark, d), "sample_id")
    return found.select("sample_id", *[_r(c, 4).alias(c) for c in ("g1_left", "g1_right", "g2_left", "g2_right")], "g2_source")


@query(_REGION_SQL + """, rg AS (SELECT sample_id, 'g1' AS label, g1_left AS a, g1_right AS z, 'left' AS clean FROM region UNION ALL SELECT sample_id, 'g2', g2_left, g2_right, 'right' FROM region),
 i AS (SELECT rg.*, b.bin, b.c, b.v FROM rg JOIN b ON b.sample_id = rg.sample_id AND b.c BETWEEN a AND z),
 t AS (SELECT sample_id, label, a, z, clean, arg_min(bin, (-v, bin)) AS p, max(v) AS top, arg_min(c, (-v, bin)) AS mean, min(bin) AS f, max(bin) AS e, arg_min(v, bin) AS vf, arg_max(v, bin) AS ve FROM i GROUP BY ALL),
 s AS (SELECT t.*, max(bin) FILTER (bin < p AND v <= 0.5 * top) AS lx, min(bin) FILTER (bin > p AND v <= 0.5 * top) AS rx, sum(greatest(0, v - (vf + (bin - f) / greatest(1, e - f) * (ve - vf)))) AS s0,
   sum(greatest(0, v - (vf + (bin - f) / greatest(1, e - f) * (ve - vf))) * (c - mean)) AS s1, sum(greatest(0, v - (vf + (bin - f) / greatest(1, e - f) * (ve - vf))) * (c - mean) * (c - mean)) AS s2 FROM t JOIN i USING (sample_id, label) GROUP BY ALL),
 x AS (SELECT s.*, w, CASE WHEN clean = 'right' THEN rx - p ELSE p - lx END / sqrt(-2 * ln(0.5)) * w AS flank, CASE WHEN s0 > 1e-12 THEN sqrt(greatest(1e-12, s2 / s0 - pow(s1 / s0, 2))) END AS moment FROM s JOIN w USING (sample_id)),
 u AS (SELECT *, CASE WHEN flank > 0 THEN flank WHEN moment > 0 THEN moment ELSE greatest(w, (z - a) / 4) END AS sigma, CASE WHEN flank > 0 THEN 'flank' WHEN moment > 0 THEN 'moment' ELSE 'span' END AS method FROM x)
 SELECT sample_id, label, p::BIGINT AS peak, round(mean, 4) AS mean, round(sigma, 4) AS sigma, round(sigma / mean, 4) AS cv, round(greatest(1, greatest(0, top - least(vf, ve)) * sqrt(2 * pi()) * sigma / w), 3) AS area, method FROM u""")
def region_estimate(spark, d):
    found = regions.proposed(_smooth(spark, d), _pairs(spark, d), "sample_id")
    each = found.select("sample_id", F.inline(F.array(*[F.struct(F.lit(g).alias("label"), F.col(f"{g}_left").alias("left"), F.col(f"{g}_right").alias("right"), F.lit(side).alias("clean")) for g, side in (("g1", "left"), ("g2", "right"))])))
    out = regions.estimated(_smooth(spark, d), each, "sample_id")
    return out.select("sample_id", "label", "peak", *[_r(c, 4).alias(c) for c in ("mean", "sigma", "cv")], _r("area", 3).alias("area"), "method")


# ---------------------------------------------------------------- sessions


@query("""SELECT c_name AS name, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation, CASE WHEN c_custkey % 4 = 0 THEN round(1.0 + c_custkey % 50, 2)::DOUBLE END AS g1_left, c_custkey % 3 = 0 AS selected FROM customer""")
def session_restore(spark, d):
    """A session of a file per customer, collected into its document, in parts, and restored from it."""
    k = F.col("c_custkey")
    files = table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_mktsegment", "c_nationkey", k)
    cells = files.select("name", F.inline(F.array(F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("field"), F.col("c_nationkey").cast("string").alias("value")))))
    left = 1.0 + k % 50
    tables = {
        "files": files.select("name", k.cast("long").alias("size")), "metadata": cells,
        "metadata_columns": spark.createDataFrame([("segment", "Segment", ""), ("nation", "Nation", "")], session.SCHEMAS["metadata_columns"]),
        "modeling": files.where(k % 4 == 0).select("name", F.lit("auto").alias("model"), left.alias("g1_left"), (left + 5).alias("g1_right"), (left + 9).alias("g2_left"), (left + 12).alias("g2_right")),
        "table": files.where(k % 3 == 0).select(F.col("name").alias("selected")),
    }
    folder = scratch(spark, "session")
    done = session.restore_parts(spark, session.collected_parts(tables, scratch(spark, "document")), folder)
    if done.status != "restored":
        raise RuntimeError(done.reason)
    read = lambda s: session.restored(spark, folder, s)
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    wide = read("metadata").groupBy("name").agg(pick("segment"), pick("nation"))
    chosen = read("table").select(F.col("selected").alias("name"), F.lit(True).alias("selected"))
    return wide.join(read("modeling").select("name", "g1_left"), "name", "left").join(chosen, "name", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


# ---------------------------------------------------------------- preflight

_PREFLIGHT = f"""WITH {LOTS}, e AS (SELECT sample_id, min(dna_a) AS lo, max(dna_a) AS hi FROM lots GROUP BY 1), h AS (SELECT sample_id, least(floor((dna_a - lo) / ((hi - lo) / 32)), 31)::BIGINT AS bin, lo, hi, count(*) AS n FROM lots JOIN e USING (sample_id) WHERE sample_id % 21 > 0 GROUP BY ALL),
 s AS (SELECT s_suppkey AS k, 20000.0 + s_suppkey % 7 * 100 AS a, 30000.0 AS b, CASE WHEN s_suppkey % 13 = 0 THEN 29000.0 ELSE 60000.0 END AS c, CASE WHEN s_suppkey % 17 = 0 THEN 60100.0 ELSE 80000.0 END AS d, s_suppkey % 11 > 0 AS placed FROM supplier),
 f AS (SELECT sample_id, sum(n) AS retained, count(*) AS nonempty, sum(n) FILTER (lo + (bin + 0.5) * ((hi - lo) / 32) BETWEEN a AND b) AS g1, sum(n) FILTER (lo + (bin + 0.5) * ((hi - lo) / 32) BETWEEN c AND d) AS g2 FROM h JOIN s ON k = sample_id GROUP BY 1),
 r AS (SELECT k, sample_id IS NOT NULL AS found, retained, nonempty, coalesce(g1, 0) AS g1, coalesce(g2, 0) AS g2, placed, c, d FROM s LEFT JOIN f ON k = sample_id)
 SELECT k AS sample_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN NOT found THEN 'histogram_missing' END, CASE WHEN found AND k % 9 * 0.04 > 0.25 THEN 'dna_ineligible' END, CASE WHEN found AND k % 6 = 0 THEN 'histogram_stale' END, CASE WHEN NOT placed THEN 'regions_missing' END,
   CASE WHEN placed AND (30000.0 > c OR c >= d) THEN 'constraint_invalid' END, CASE WHEN placed AND k % 5 = 0 THEN 'regions_unreviewed' END, CASE WHEN k % 19 = 0 THEN 'regions_stale' END, CASE WHEN k % 23 = 0 THEN 'dna_ineligible' END, CASE WHEN k % 29 = 0 THEN 'logarithmic' END,
   CASE WHEN k % 29 > 0 AND k % 31 = 0 THEN 'fcs_transform_state_invalid' END, CASE WHEN found AND retained < 100 THEN 'events_insufficient' END, CASE WHEN found AND nonempty < 5 THEN 'histogram_support_insufficient' END, CASE WHEN found AND placed AND least(g1, g2) < 10 THEN 'peak_support_insufficient' END,
   CASE WHEN k % 4 = 1 OR k % 8 = 2 THEN 'qc_not_passed' END, CASE WHEN k % 10 = 7 THEN 'qc_critical_removal' END, CASE WHEN k % 37 = 0 THEN 'configuration_invalid' END], lambda x: x IS NOT NULL))), ',') AS reasons, coalesce(retained, 0)::BIGINT AS retained FROM r"""


@query(_PREFLIGHT)
def preflight_reasons(spark, d):
    """Every reason against a fit of each supplier's lots."""
    bins = samples.histogram(_lots(spark, d).where(F.col("sample_id") % 21 > 0), "sample_id", "dna_a", 32)
    k = F.col("s_suppkey")
    ends = F.struct((20000.0 + k % 7 * 100).alias("g1_left"), F.lit(30000.0).alias("g1_right"), F.when(k % 13 == 0, 29000.0).otherwise(60000.0).alias("g2_left"), F.when(k % 17 == 0, 60100.0).otherwise(80000.0).alias("g2_right"))
    stage = lambda name, required, status, percent: F.struct(F.lit(name).alias("name"), F.lit(required).alias("required"), status.alias("status"), percent.cast("double").alias("percent"), F.lit(False).alias("acknowledged"))
    qc = F.array(stage("structural", True, F.when(k % 4 == 1, "degraded").otherwise("applied"), F.lit(10)), stage("time", False, F.when(k % 8 == 2, "failed").otherwise("skipped"), F.when(k % 10 == 7, 60).otherwise(1)))
    rows = table(spark, d, "supplier").select(
        k.alias("sample_id"), F.lit(100).alias("mask_retained"), (k % 9 * 4).alias("rejected"), F.when(k % 11 > 0, ends).alias("regions"), (k % 5 > 0).alias("reviewed"), (k % 19 == 0).alias("stale"),
        F.when(k % 23 > 0, "DNA-A").alias("channel"), F.when(k % 29 == 0, "logarithmic").otherwise("linear").alias("eligibility"), F.when(k % 31 == 0, 1).otherwise(0).alias("transforms"), qc.alias("qc"),
        F.create_map(F.lit("cv"), F.when(k % 37 > 0, 0.05).otherwise(float("nan"))).alias("config"),
    )
    known = preflight.histogram_fingerprint(bins, "sample_id").withColumn("seen_fingerprint", F.when(F.col("sample_id") % 6 == 0, "old").otherwise(F.col("fingerprint"))).drop("fingerprint")
    found = preflight.preflight(bins, rows.join(known, "sample_id", "left"), "sample_id")
    return found.select("sample_id", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), "retained")
