"""Importance resampling towards a target distribution: hashed word n-grams, gains per bucket, Gumbel keys, exact top share.

One scan per document keeps a ring of running CRC-32 states, one for each of the last n - 1 word starts; every word extends each
state by a space and itself, so all n-grams of up to n words are hashed without being built. The scan emits a document's buckets and
their counts, at most as many as there are buckets however long the text is; texts are not read again.

Nulls, ties and the like: a null text is an empty one and has no features, weight 0; a null id is drawn for as an empty string and
ranks last among equal scores; rows that repeat an id have equal draws and, if all else is equal, arbitrary ranks among themselves;
of empty tables the result is empty, and an empty target has no counts (T = 0). Columns named as new ones give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, ASCII_UPPER, lean, mapped, small_batches, with_columns, written

#: Upper case to lower case, all bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] to spaces.
_WORDS = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
_WORDS = bytes(0x20 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else _WORDS[b] for b in range(256))


def words(text: memoryview, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, about `most` bytes of it at a time."""
    rest = b""
    for at in range(0, len(text), most):
        piece = rest + bytes(text[at : at + most]).translate(_WORDS)
        end = len(piece) if at + most >= len(text) else piece.rfind(b" ") + 1
        rest = piece[end:]
        yield piece[:end].split()


def crc_ring(pieces: Iterator[list[bytes]], least: int, most: int) -> Iterator[tuple[int, list[int]]]:
    """(number of words, CRC-32 of every run of least..most words that ends in them) of each piece of one document."""
    ring: list[int] = []  # states of the runs that end in the last word, the longest first, most - 1 at most
    for piece in pieces:
        if most == 1:
            yield len(piece), [crc32(w) for w in piece]
            continue
        found = []
        for word in piece:
            more = b" " + word
            ring = [*(crc32(more, s) for s in ring), crc32(word)]
            found += ring[: max(0, len(ring) - least + 1)]
            ring = ring[1 - most :]
        yield len(piece), found


def features(docs: DataFrame, *, text: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """docs with n_words, n_features and bucket_counts, array<struct<bucket, count>> by bucket: runs of least..most consecutive
    words, by their CRC-32 modulo buckets."""
    if not 1 <= least <= most:
        raise ValueError("1 <= least <= most is needed")

    def scan(columns: Iterator[pa.Array]) -> Iterator[list]:
        for column in columns:
            n_words, n_features, ends, keys, counts = [], [], [0], [], []
            for value in column:
                sums, n, m = np.zeros(0, np.int64), 0, 0
                for some, states in crc_ring(words(memoryview(value.as_buffer() or b"") if value.is_valid else memoryview(b"")), least, most):
                    one = np.bincount(np.array(states, np.uint32) % np.uint32(buckets), minlength=len(sums)) if states else sums
                    one[: len(sums)] += sums if one is not sums else 0
                    sums, n, m = one, n + some, m + len(states)
                at = np.flatnonzero(sums)
                n_words.append(n), n_features.append(m), keys.append(at), counts.append(sums[at]), ends.append(ends[-1] + len(at))
            pair = pa.StructArray.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int32)), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))], names=["bucket", "count"])
            yield [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)]

    return mapped(docs, text, {"n_words": "long", "n_features": "long", "bucket_counts": "array<struct<bucket:int,count:long>>"}, scan)


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, count, offsets) of a column bucket_counts."""
    flat = column.flatten()
    off = column.offsets.to_numpy().astype(np.int64)
    return flat.field("bucket").to_numpy(), flat.field("count").to_numpy(), off - off[0]


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """Counts of every bucket over all rows of features(): each task adds up its own, `buckets` rows at most."""
    small_batches(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, count, _ = _pairs(batch.column(0))
            np.add.at(sums, bucket, count)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("bucket_counts").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one a bucket."""
    size = len(source)
    s, t = int(source.sum()) + size, int(target.sum()) + size
    return np.array([math.floor(1000 * math.log((float(b) + 1) * float(s) / ((float(a) + 1) * float(t)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows of features() with weight, the sum of gains over a row's features, in place of bucket_counts."""
    keep = [c for c in found.columns if c.lower() not in ("bucket_counts", "weight")]
    plain = found.select(*[found[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(keep)], found["bucket_counts"].alias("pairs"))
    sent = found.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, count, off = _pairs(batch.column(batch.num_columns - 1))
            sums = np.zeros(len(bucket) + 1, np.int64)
            np.cumsum(sent.value[bucket] * count, out=sums[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums[off[1:]] - sums[off[:-1]])], names=[*batch.schema.names[:-1], "weight"])

    schema = plain.drop("pairs").schema.add("weight", "long")
    return plain.mapInArrow(run, schema).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "weight")


def gumbel(seed: int, key: Column) -> Column:
    """floor(1000 g), g the standard Gumbel draw of a key: from the first 32 bits of sha256("seed:key")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, chosen: Column, order: list[Column]) -> DataFrame:
    """rows with rank: 1, 2, 3, ... of the chosen rows in the given order, null for others.

    Rows are dealt by ranges of the order and sorted within them; a row's place is its place in its range and the sizes of the
    ranges before it, so no task holds more than a range.
    """
    spark = rows.sparkSession
    sort = [F.desc("_chosen"), *order]
    dealt = rows.withColumn("_chosen", F.coalesce(chosen, F.lit(False))).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", 33)
    sizes = placed.where("_chosen").groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a partition
    at = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part", "left").withColumn("rank", F.when(F.col("_chosen"), at)).drop("_chosen", "_at", "_part", "_before")


def resampled(docs: DataFrame, target: DataFrame, *, text: str = "text", id: str = "doc_id", least: int = 1, most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """docs without text, with n_words, n_features, weight, score and rank.

    weight: the sum over a document's features of floor(1000 ln(their share in target / their share in docs)). score: weight and
    1000 times a Gumbel draw, so the highest scores are a draw without replacement in proportion to exp(weight / 1000). rank: 1, 2,
    ... of the floor(percent N / 100) highest scores of the N documents of at least least_words words; null if not drawn.
    """
    scan = lambda df, name: written(features(df, text=text, least=least, most=most, buckets=buckets).drop(text), name)
    found, aim = scan(docs, "features"), scan(target.select(F.col(text)), "target-features")
    rows = weighed(found, gains(totals(found, buckets), totals(aim, buckets)))
    rows = with_columns(rows, score=F.col("weight") + gumbel(seed, F.col(id)))
    drawn = found.where(F.col("n_words") >= least_words).count() * percent // 100
    out = ranked(rows, F.col("n_words") >= least_words, [F.desc("score"), F.asc_nulls_last(id)])
    return out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
