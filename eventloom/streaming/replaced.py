"""Statistics of samples over a stream of files, of which some are replaced and some come twice.

A sample's state maps each of its files to what the file's values come to and to the file's digest and version. A file that comes with
another digest and a later version takes the old one's place, so the old sums go; one with a digest that is known, or an older version,
changes nothing. Tasks sum their own rows first, so the state gets a row per file and task, not an event.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SUMS = "n long, mean double, m2 double, low double, high double"
STATS = "n long, mean double, sd double, min double, max double, files long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Sums = tuple[int, float, float, float, float]
NONE: Sums = (0, 0.0, 0.0, float("inf"), float("-inf"))


def merged(a: Sums, b: Sums) -> Sums:
    n = a[0] + b[0]
    if not n:
        return NONE
    away = b[1] - a[1]
    return (n, a[1] + away * b[0] / n, a[2] + b[2] + away * away * a[0] * b[0] / n, min(a[3], b[3]), max(a[4], b[4]))


def partial_sums(events: DataFrame, value: str) -> DataFrame:
    """events(sample, file, digest, version, path, value) -> a row of sums for each path, of each batch of a task; values that are
    not finite or below zero don't count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, part in b.groupby(["sample", "file", "digest", "version", "path"], sort=False, dropna=False):
                x = part["value"].to_numpy(np.float64, na_value=np.nan)
                x = x[np.isfinite(x) & (x >= 0)]
                rows.append((*key, *((len(x), x.mean(), ((x - x.mean()) ** 2).sum(), x.min(), x.max()) if len(x) else NONE)))
            yield pd.DataFrame(rows, columns=["sample", "file", "digest", "version", "path", "n", "mean", "m2", "low", "high"])

    plain = events.select(*[F.col(c).cast(t).alias(c) for c, t in (("sample", "string"), ("file", "string"), ("digest", "string"), ("version", "long"), ("path", "string"))], F.col(value).cast("double").alias("value"))
    return plain.mapInPandas(run, f"sample string, file string, digest string, version long, path string, {SUMS}")


class _Files(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "file string", f"digest string, version long, {SUMS}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str, dict[tuple[int, str], dict[str, Sums]]] = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                own = came.setdefault(r.file, {}).setdefault((int(r.version), r.digest), {})
                own[r.path] = merged(own.get(r.path, NONE), (int(r.n), r.mean, r.m2, r.low, r.high))
        changed = False
        for file, versions in came.items():
            (version, digest), paths = max(versions.items(), key=lambda v: v[0])
            have = self.files.getValue((file,)) if self.files.containsKey((file,)) else None
            if have is not None and (have[0] == digest or (have[1], have[0]) >= (version, digest)):
                continue
            self.files.updateValue((file,), (digest, version, *paths[min(paths)]))  # of copies, one
            changed = True
        if changed:
            total, count = NONE, 0
            for _, v in self.files.iterator():
                total, count = merged(total, tuple(v[2:])), count + 1
            n, mean, m2, low, high = total
            yield pd.DataFrame([(key[0], n, *((mean, (m2 / n) ** 0.5, low, high) if n else (None,) * 4), count)], columns=["sample", "n", "mean", "sd", "min", "max", "files"])

    def close(self) -> None:
        pass


def replaceable_stats(events: DataFrame, value: str) -> DataFrame:
    """A stream of (sample, n, mean, sd, min, max, files) in update mode: a row for a sample whenever its files have changed.

    events has sample, file, digest, version (later ones replace), path (where the rows were read: the same content may come by
    two paths) and the value; a file's rows come in one batch, as Spark's file sources deliver them. The session must use the
    RocksDB state store, PROVIDER.
    """
    schema = f"sample string, {STATS}"
    return partial_sums(events, value).groupBy("sample").transformWithStateInPandas(statefulProcessor=_Files(), outputStructType=schema, outputMode="Update", timeMode="None")


def current_stats(events: DataFrame, value: str) -> DataFrame:
    """The same of a table of all arrivals: what the stream must come to."""
    x = F.when(F.col(value).between(0, float("inf")) & (F.col(value) < float("inf")), F.col(value))
    copies = events.groupBy("sample", "file", "digest").agg(F.min(F.struct("version", "path")).alias("first"))
    last = copies.groupBy("sample", "file").agg(F.max(F.struct(F.col("first.version").alias("version"), "digest", F.col("first.path").alias("path"))).alias("l")).select("sample", "file", "l.digest", "l.path")
    return events.join(last, ["sample", "file", "digest", "path"]).groupBy("sample").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.countDistinct("file").alias("files"))
