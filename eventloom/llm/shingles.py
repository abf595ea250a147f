"""The shingles of texts in order of rarity, counted over all texts in shards on the executors.

A sketch that is broadcast has a size fixed beforehand: beyond it nearly every shingle looks repeated, and what follows grows with
the whole text instead of its repeated part. Here the cells grow with the texts, and no task or process holds them all:

1. The texts are a table bucketed by chunk, so both passes find a chunk's texts together, without shuffling them again.
2. First pass: a chunk sends, to each shard of the cells, those that its texts have, sorted and delta-coded (some two bytes each).
3. A shard adds up what all chunks sent and answers each with two bits a cell: seen more than once, and `many` times or more.
4. Second pass: a chunk meets its answers and keeps, of each text, the repeated shingles in order of rarity.

There are 16 cells or more for each shingle, so one in 16 of those seen once at most looks repeated, whatever the size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, ASCII_UPPER, forget, release, removed, shared_dir, written
from .windows import Plan, anchors, streams

#: A cell's place in its shard has so many bits at most: a shard's counts are 64 MB in the task that adds them up.
SHARD_BITS = 26


class Cells(NamedTuple):
    """2^bits cells in 2^shard_bits shards, by the first bits of a shingle's hash."""

    bits: int
    shard_bits: int

    def of(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def edges(self, cells: np.ndarray) -> np.ndarray:
        """Where each shard begins among sorted cells."""
        return np.searchsorted(cells, np.arange((1 << self.shard_bits) + 1, dtype=np.uint64) << np.uint64(self.bits - self.shard_bits))


def cells_for(shingles: int) -> Cells:
    bits = max(20, int(shingles).bit_length() + 4)
    return Cells(bits, max(0, bits - SHARD_BITS))


def _packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted cells and how often each came, up to 255."""
    steps = np.diff(cells, prepend=np.uint64(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 5
    return np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel(), dtype=np.int64), raw[4 * n :]


def _table(names: str, *columns) -> pa.Table:
    return pa.Table.from_arrays(list(columns), names=names.split())


def _sets(texts: pa.Table, classes: pa.Table, plan: Plan, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words of each text, its place among them for each shingle, the shingle), shingles once a text and sorted; of the texts, one
    for each class, that its smallest document has."""
    left = set(zip(classes.column("node").to_pylist(), classes.column("words").to_pylist(), strict=True))
    nodes = {node for node, _ in left}
    ids = texts.column("id").to_pylist()
    for first, s in streams(texts.column("text"), plan.kind):
        at = np.full(len(s.row_at) - 1, -1)
        words: list[int] = []
        for r in np.flatnonzero(np.diff(s.row_at) >= plan.length).tolist():
            if (node := ids[first + r]) in nodes:
                h = xxhash.xxh64_intdigest(s.body[s.at[s.row_at[r]] : s.at[s.row_at[r + 1]] - s.gap], seed)
                own = (node, h - (h >> 63 << 64))
                if own in left:
                    left.remove(own)
                    at[r] = len(words)
                    words.append(own[1])
        if words:
            found = anchors(s, plan)  # of windows as long as their anchors: each window's own hash
            row = at[np.searchsorted(s.row_at, found.low, "right") - 1]
            row, h = row[row >= 0], found.hash[row >= 0]
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
            yield np.array(words, np.int64), row[new], h[new]


def bucketed(docs: DataFrame, chunks: int, buckets: int, *, text: str, doc_id: str) -> tuple[DataFrame, str, str]:
    """docs(chunk, id, text in lower case) as a table bucketed by chunk, its name and its path; rows without id are left out."""
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), ASCII_UPPER, ASCII_LOWER).alias("text"))
    rows = rows.where("id is not null").select(_chunk("id", chunks), "id", "text")
    rows.repartition(buckets, "chunk").write.format("parquet").option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name), name, path


def _chunk(node: str, chunks: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(node)), F.lit(chunks)).cast("int").alias("chunk")


def shingle_sets(docs: DataFrame, classes: DataFrame, *, text: str, doc_id: str, shingle: int, similarity: float, seed: int = 42, many: int = 8) -> tuple[DataFrame, DataFrame]:
    """docs and classes(words, node: the smallest document of these words) -> sets(words, n, shingles) and heads(key, words, n,
    place), of the classes that can have a Jaccard similarity of `similarity` or more with another. Both are tables of their own.

    Shingles (64-bit hashes) are ordered by how often they were seen (once, more, `many` or more, by cells of hashes, so never too
    seldom), then by hash. Two sets of that similarity share one among the first n - ceil(similarity * n) + 1 of each, which are the
    heads. A shingle seen once is in no other text, so it is counted in n but not sent; a text without heads is similar to none; nor
    is one of fewer words than a shingle, unless to one of the same words."""
    spark, plan = docs.sparkSession, Plan("words", shingle, shingle)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    cells = cells_for(size // 6)
    # about 16 MB a bucket, but as many as other shuffles have, unless the texts are few; several chunks each, as their keys are dealt by hash
    buckets = max(1, size >> 24, min(size >> 20, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    chunks = 4 * buckets
    texts, name, path = bucketed(docs, chunks, buckets, text=text, doc_id=doc_id)
    of = classes.select(_chunk("node", chunks), "words", "node")

    def count(key: tuple, mine: pa.Table, own: pa.Table) -> pa.Table:
        have = [h for _, _, h in _sets(mine, own, plan, seed)]
        seen, n = np.unique(cells.of(np.concatenate([np.zeros(0, np.uint64), *have])), return_counts=True)
        edges = cells.edges(seen)
        shards = np.flatnonzero(np.diff(edges))
        base = shards.astype(np.uint64) << np.uint64(cells.bits - cells.shard_bits)
        blobs = [_packed(seen[b:e] - low, n[b:e]) for b, e, low in zip(edges[shards], edges[shards + 1], base, strict=True)]
        release()
        return _table("shard chunk cells", pa.array(shards, pa.int32()), pa.array([key[0].as_py()] * len(shards), pa.int32()), pa.array(blobs, pa.binary()))

    def answer(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << (cells.bits - cells.shard_bits), np.uint8)
        asked = []
        for blob in table.column("cells").to_pylist():
            at, n = _unpacked(blob)
            total[at] = np.minimum(total[at].astype(np.int16) + n, 255)
            asked.append(at.astype(np.uint32))
        pack = zstandard.ZstdCompressor(level=1)
        level = (total >= 2).astype(np.uint8) + (total >= many)
        bits = [pack.compress(np.concatenate([np.packbits(level[at] >= k, bitorder="little") for k in (1, 2)]).tobytes()) for at in asked]
        return _table("chunk shard bits", table.column("chunk"), table.column("shard"), pa.array(bits, pa.binary()))

    def keep(mine: pa.Table, right: pa.Table) -> pa.Table:
        answers, own = right.filter(pc.is_valid(right.column("bits"))), right.filter(pc.is_valid(right.column("node")))
        found = list(_sets(mine, own, plan, seed))
        seen = np.unique(cells.of(np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in found)])))
        edges, level = cells.edges(seen), np.zeros(len(seen), np.int8)
        unpack = zstandard.ZstdDecompressor()
        for shard, bits in zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            n = int(edges[shard + 1] - edges[shard])
            two = np.unpackbits(np.frombuffer(unpack.decompress(bits), np.uint8).reshape(2, -1), axis=1, count=n, bitorder="little")
            level[edges[shard] : edges[shard + 1]] = two.sum(axis=0)
        out: list[list] = [[], [], []]
        for words, row, h in found:
            rank = level[np.searchsorted(seen, cells.of(h))]
            sizes, again = np.bincount(row, minlength=len(words)), np.bincount(row[rank > 0], minlength=len(words))
            order = np.lexsort((h, rank, row))
            ends = np.cumsum(sizes)
            for r in np.flatnonzero(sizes - again <= sizes - np.ceil(similarity * sizes - 1e-6)).tolist():
                if again[r]:
                    out[0].append(words[r])
                    out[1].append(int(sizes[r]))
                    out[2].append(h[order[ends[r] - again[r] : ends[r]]].view(np.int64))
        release()
        return _table("words n shingles", pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())))

    asked = texts.groupBy("chunk").cogroup(of.groupBy("chunk")).applyInArrow(count, "shard int, chunk int, cells binary")
    answers = written(asked.groupBy("shard").applyInArrow(answer, "chunk int, shard int, bits binary"), "answers")
    right = answers.select("chunk", "shard", "bits", F.lit(None).cast("long").alias("words"), F.lit(None).cast("long").alias("node"))
    right = right.unionByName(of.select("chunk", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("bits"), "words", "node"))
    sets = written(texts.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(keep, "words long, n int, shingles array<long>"), "sets")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    removed(spark, path)
    forget(answers)
    once = F.col("n") - F.size("shingles")  # these come first
    sent = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-6) + 1 - once).cast("int")
    heads = sets.select("words", "n", once.alias("once"), F.posexplode(F.slice("shingles", F.lit(1), F.least(sent, F.size("shingles")))).alias("at", "key"))
    return sets, written(heads.select("key", "words", "n", (F.col("once") + F.col("at")).cast("int").alias("place")), "heads")
