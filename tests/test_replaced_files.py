"""A stream in which files are replaced, repeated and late comes to what the current files come to."""

import math

import pytest

from eventloom.streaming import replaced

SCHEMA = "sample string, file string, digest string, version long, path string, x double"


def arrivals():
    def rows(sample, file, digest, version, path, xs):
        return [(sample, file, digest, version, path, x) for x in xs]

    first = rows("a", "a1", "d1", 1, "p1", [1.0, 2.0, 3.0]) + rows("a", "a2", "d2", 1, "p2", [10.0, float("nan")]) + rows("b", "b1", "d3", 1, "p3", [5.0, -1.0])
    second = rows("a", "a1", "d4", 2, "p4", [7.0, 8.0]) + rows("a", "a2", "d2", 5, "p5", [10.0, float("nan")]) + rows("c", "c1", "d5", 1, "p6", [4.0]) + rows("c", "c1", "d5", 1, "p7", [4.0])
    third = rows("a", "a1", "d0", 0, "p8", [99.0]) + rows("b", "b1", "d6", 2, "p9", [float("inf")])
    return [first, second, third]


def test_replaced_and_repeated_files_equal_the_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, replaced.PROVIDER)
    try:
        folder, latest = str(tmp_path / "in"), {}

        def keep(batch, _):
            latest.update({r["sample"]: r for r in batch.collect()})

        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        q = replaced.replaceable_stats(stream, "x").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep).start()
        for rows in arrivals():
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(key, before)
    want = {"a": (3, 25 / 3, 7.0, 10.0, 2), "b": (0, None, None, None, 1), "c": (1, 4.0, 4.0, 4.0, 1)}
    assert {s: (r.n, r["mean"] and round(r["mean"], 9), r["min"], r["max"], r.files) for s, r in latest.items()} == {s: (n, m and round(m, 9), a, b, f) for s, (n, m, a, b, f) in want.items()}
    batch = {r["sample"]: r for r in replaced.current_stats(spark.createDataFrame(sum(arrivals(), []), SCHEMA), "x").collect()}
    for s, r in latest.items():
        assert (r.n, r.files, r["min"], r["max"]) == (batch[s].n, batch[s].files, batch[s]["min"], batch[s]["max"])
        assert r.sd is None and batch[s].sd is None or math.isclose(r.sd, batch[s].sd)


def test_sums_merge_in_any_grouping():
    a, b = (2, 1.5, 0.5, 1.0, 2.0), (1, 9.0, 0.0, 9.0, 9.0)
    assert replaced.merged(replaced.NONE, a) == a and replaced.merged(replaced.NONE, replaced.NONE) == replaced.NONE
    n, mean, m2, low, high = replaced.merged(a, b)
    assert (n, mean, low, high) == (3, 4.0, 1.0, 9.0) and math.isclose(m2, 9 + 4 + 25)
