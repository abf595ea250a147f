"""Counts of shingles in shards: they have no size fixed beforehand, and little is left on the disks."""

import os
import random
import re

import pyarrow.dataset as pads
from pyspark.sql import functions as F

from eventloom.llm import shingles, simhash
from eventloom.llm.shared import shared_dir


def tables(spark):
    """Names of the tables in the shared folder that have rows."""
    top = shared_dir(spark).removeprefix("file://")
    return {re.sub(r"[-_][0-9a-f]{32}$", "", n) for n in os.listdir(top) if re.search(r"[-_][0-9a-f]{32}$", n) and pads.dataset(f"{top}/{n}", format="parquet").count_rows()}


def test_cells_grow_with_the_shingles():
    for n in (0, 1, 10**6, 1 << 26, 2 * 10**9, 10**11):
        cells = shingles.cells_for(n)
        assert 16 * n <= 1 << cells.bits and cells.bits - cells.shard_bits <= shingles.SHARD_BITS and cells.bits <= 63


def test_only_repeated_shingles_are_sent(spark):
    """3 MB of texts in several chunks: what two texts share is sent with its right place, of the rest about one in 16 to 32 at most."""
    rnd = random.Random(8)
    rows = [[f"w{rnd.randint(0, 10**9)}" for _ in range(400)] for _ in range(800)]
    for k in range(0, 100, 2):
        rows[k + 1][:350] = rows[k][:350]
    df = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in enumerate(rows)] + [(900, " ".join(rows[0])), (None, "a b c d e f")], "doc_id long, text string").repartition(4)
    prints = simhash.fingerprints(df, shingle=5, whole=True).where("doc_id is not null")
    classes = prints.groupBy("words").agg(F.min("doc_id").alias("node"))
    sets, heads = shingles.shingle_sets(df, classes, text="text", doc_id="doc_id", shingle=5, similarity=0.8)
    node = {r.words: r.node for r in classes.collect()}
    found = {node[r.words]: r for r in sets.collect()}
    for k in range(0, 100, 2):
        one, two = found[k], found[k + 1]
        assert one.n == two.n == 396 and len(set(one.shingles) & set(two.shingles)) == 346
    assert all(k < 100 for k, r in found.items() if len(r.shingles) > 0.1 * r.n + 20)
    keys = {}
    for r in heads.collect():
        assert r.place <= r.n - 0.8 * r.n and r.n == found[node[r.words]].n
        keys.setdefault(r.key, set()).add(node[r.words])
    shared = [s for s in keys.values() if len(s) > 1]
    assert {min(s) for s in shared} == set(range(0, 100, 2)) and all(max(s) == min(s) + 1 for s in shared)


def test_groups_leave_one_table_and_the_session_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rnd, conf = random.Random(9), spark.conf.get(key, None)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(100)]
    df = spark.createDataFrame([(k, " ".join([*base[:k], "x", *base[k:]])) for k in range(0, 100, 7)], "doc_id long, text string")
    before, named = tables(spark), {t.name for t in spark.catalog.listTables()}
    out = simhash.groups(df)
    assert tables(spark) - before <= {"groups"} and {t.name for t in spark.catalog.listTables()} == named and spark.conf.get(key, None) == conf
    assert {r.component for r in out.collect()} == {0}
