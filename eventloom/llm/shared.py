"""What several operators of this subpackage share: folders that all executors see, text buffers as arrays,
hash arithmetic on them, and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
LOWER_TABLE = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
#: Stands for a null doc_id in comparisons: nulls rank after every document.
LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees. Where it is unset, a local one on a local master, whose
    executor is this process; on a cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="eventloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes a table that written() made."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:  # none, if the table has no rows
        removed(df.sparkSession, f)


def removed(spark: SparkSession, folder: str) -> None:
    """Removes a folder and what is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it has ended. Else they stay until the driver collects its garbage, which it does
    by its own memory: with the same number of queries over larger tables, ever more of them lie on the disks at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def with_columns(df: DataFrame, **new) -> DataFrame:
    """df with the new columns; a column of df whose name differs from a new one in case only, or not at all, gives way."""
    names = {n.lower() for n in new}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names], *[v.alias(n) for n, v in new.items()])


def release() -> None:
    """Gives memory that this process has freed back to the system. Idle workers stay alive beside the next tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python 1,000 rows at a time where the session has Spark's default of 10,000: it counts rows, not bytes, and
    a batch is held by the executor and by its Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def lean(run: Callable) -> Callable:
    """run, a function for mapInArrow, that gives its memory back when a task ends."""

    def until_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return until_end


# ---------------------------------------------------------------- arrays of text


def text_arrays(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, offsets) of slices of rows with about `most` bytes each; a longer row is a slice of its own.
    Null counts as empty. offsets has one entry more than the slice has rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    off = np.frombuffer(off_buf, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


SPACE_TABLE = np.zeros(256, bool)
SPACE_TABLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F], for lower-cased text.
PUNCT_TABLE = np.zeros(256, bool)
PUNCT_TABLE[:0x30] = PUNCT_TABLE[0x3A:0x61] = PUNCT_TABLE[0x7B:0x80] = True


def words_of(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of a slice; words end at separators and at the end of a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separators[data]
    before = np.empty(len(data) + 1, bool)  # whether the byte before i belongs to the same word as i
    before[0] = before[-1] = False
    np.logical_and(inside[1:], inside[:-1], out=before[1:-1])
    before[off[(off > 0) & (off < len(data))]] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~before[1:]) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def renamed(docs: DataFrame, text: str, new: list[str]) -> tuple[DataFrame, list[str], list[str], str]:
    """(docs under names c0, c1, ... , these names, the names they stand for, the name of the text as a string). Columns that
    are named as `new` ones, whatever their case, give way."""
    lower = {n.lower() for n in new}
    columns = [c for c in docs.columns if c.lower() not in lower or c == text]
    names = [f"c{k}" for k in range(len(columns))]
    plain = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(columns, names, strict=True)])
    own = names[columns.index(text)]
    if dict(plain.dtypes)[own] != "string":
        plain, own = plain.withColumn("own_text", F.col(own).cast("string")), "own_text"
    return plain, names, columns, own


def mapped(docs: DataFrame, text: str, new: dict[str, str], run: Callable[[Iterator[pa.Array]], Iterator[list]]) -> DataFrame:
    """docs with the columns `new` (name -> type), which run() makes from the texts, batch by batch. All other columns pass
    through, but for those named as new ones."""
    small_batches(docs.sparkSession)
    plain, names, columns, own = renamed(docs, text, list(new))
    at, kept = plain.columns.index(own), [k for k, n in enumerate(names) if columns[k] == text or columns[k].lower() not in new]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for batch in rows:
                have.append(batch)
                yield batch.column(at)

        for made in run(texts()):
            batch = have.pop()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], names=[*(names[k] for k in kept), *new])

    schema = T.StructType([*(plain.schema.fields[k] for k in kept), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in new.items())])
    out = plain.mapInArrow(lean(batches), schema)
    return out.select(*[F.col(names[k]).alias(columns[k]) for k in kept if columns[k].lower() not in new], *new)


# ---------------------------------------------------------------- hash arithmetic modulo 2^64

_SEEDS = np.random.default_rng(0x5EED)
BYTE_VALUES = _SEEDS.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base, and of its inverse modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        pair = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def prefix_sums(symbols: np.ndarray, which: int) -> np.ndarray:
    """S with S[i] = sum of symbols[j] * base^j for j < i: the polynomial hash of any range in O(1), by range_hash()."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(which, len(symbols))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end]; equal for equal ranges wherever they stand."""
    return (sums[end] - sums[start]) * powers(which, len(sums))[1][start]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of h reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    sums = prefix_sums(BYTE_VALUES[which][data], which)
    return mixed(range_hash(sums, which, start, end) + (end - start).astype(np.uint64))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] entries, then the same for the next one."""
    total = int(length.sum())
    at = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) if len(length) else np.zeros(0, np.int64)
    return at + np.arange(total)


# ---------------------------------------------------------------- connected components


def few_files(df: DataFrame, rows: int, a_file: int = 100_000) -> DataFrame:
    """df in no more partitions than `rows` rows need: small tables in many files cost more disk and tasks than their rows do."""
    return df.coalesce(max(1, -(-rows // a_file)))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> (node, component): for every node of an edge the smallest node that it reaches, as a table of its
    own.

    Alternates large-star and small-star steps, each a minimum per node and a join back, until only stars are left. Both run as
    partial aggregates and joins that Spark can split, so a hub does not land in one task; every round is written to the
    shared folder. Self-links, repeated and reversed links are allowed; links with a null end are ignored.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    n = now.count()
    for _ in range(most_rounds):
        ends = now.select(a.alias("v"), F.lit(1).alias("down")).unionByName(now.select(b.alias("v"), F.lit(0).alias("down")))
        if ends.groupBy("v").agg(F.sum("down").alias("links"), F.min("down").alias("least")).where("links > 1 OR links = 1 AND least = 0").isEmpty():
            break  # every node has one link down, to a node that has none: stars
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where(F.col("b") > F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = down.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("n").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        after = written(few_files(small, n), "links")
        forget(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = written(few_files(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), n), "components")
    forget(now)
    return found
