"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Equal vectors of a label are one class with a multiplicity and a number of its own, as rows may share a vec_id. A rotation of the principal axes that balances the signs is
learnt on a bounded sample; the signs of a rotated vector are its code. The code is split into `tables` substrings, each with a
hash table per label; a vector probes all substrings within `radius` bits of its own. A pair is verified in the first table
that brings it together, so no pair is sent twice, and reranked by the cosine of the original vectors in double precision.

Pairs whose codes differ by at most tables * (radius + 1) - 1 bits are always found; others are found if some substring is near.
Links are pairs found with cosine >= least_cosine; the tests measure recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, forget, lean, written


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projection of d x bits) by iterative quantisation: alternately the nearest sign matrix and the rotation that
    brings the principal components nearest to it."""
    centre = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - centre, full_matrices=False)
    axes = axes[:bits]
    v = (x - centre) @ axes.T
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(axes), len(axes))))[0]
    for _ in range(rounds):
        signs = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        rotation = (left @ right).T
    return centre, axes.T @ rotation


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least_cosine: float = 0.93, bits: int = 64, tables: int = 4, radius: int = 1, fit_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    fit_rows: the rotation is learnt on so many representatives, those with the smallest hashes of vec_id; every row is indexed.

    Defined cases: rows with a null label or vec_id, and vectors that are null, empty, zero or hold a null or non-finite
    component, link with nothing and keep themselves; vectors of different lengths don't link; equal vectors link; rows that
    share a vec_id count as vectors of their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    e = F.col(embedding)
    good = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    plain = F.transform(e, lambda v: v.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), F.struct(F.col(label).cast("string").alias("label"), plain.alias("v"))).alias("s")).select("vec_id", "s.label", "s.v", F.xxhash64("s.label", "s.v").alias("h1"), F.xxhash64(F.lit(1), "s.v", "s.label").alias("h2"))
    usable = rows.where("v is not null")
    classes = written(usable.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "v")).alias("s"), F.count(F.lit(1)).alias("mult")).select("h1", "h2", F.monotonically_increasing_id().alias("rep"), F.col("s.vec_id").alias("least"), "s.label", "s.v", "mult"), "classes")

    lengths = [r[0] for r in classes.select(F.size("v")).distinct().limit(65).collect()]
    if len(lengths) > 64:
        raise ValueError("embeddings of over 64 different lengths")
    fits = {}
    for d in lengths:
        sample = classes.where(F.size("v") == d).orderBy(F.xxhash64("least"), "least", "h1").limit(fit_rows).select("v").toArrow().column(0).combine_chunks()
        fits[d] = learn_rotation(_matrix(sample), min(bits, d))
    shared = spark.sparkContext.broadcast(fits)
    width = {d: [len(p) for p in np.array_split(np.arange(min(bits, d)), tables)] for d in lengths}
    masks = {d: [int(sum(1 << int(b) for b in p)) for p in np.array_split(np.arange(min(bits, d)), tables)] for d in lengths}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                centre, projection = shared.value[d]
                sign = (_matrix(part.column(2)) - centre) @ projection >= 0
                code = np.zeros((len(sign), 64), np.uint8)
                code[:, : sign.shape[1]] = sign
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(sign), d, np.int32)), pa.array(np.packbits(code, axis=1, bitorder="little").view(np.int64)[:, 0])], names=["rep", "label", "d", "code"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the tables, and probes of every substring within `radius` bits."""
        for whole in batches:
            for start in range(0, whole.num_rows, 8192):
                batch = whole.slice(start, 8192)
                code, size = batch.column(3).to_numpy().view(np.uint64), batch.column(2).to_numpy()
                for d in np.unique(size).tolist():
                    at = np.flatnonzero(size == d)
                    shift = 0
                    for t, w in enumerate(width[d]):
                        value = ((code[at] >> np.uint64(shift)) & np.uint64((1 << w) - 1)).astype(np.int64)
                        shift += w
                        flips = np.array([sum(1 << b for b in c) for r in range(min(radius, w) + 1) for c in combinations(range(w), r)], np.int64)
                        for probe, key, who in ((False, value, at), (True, (value[:, None] ^ flips[None, :]).ravel(), np.repeat(at, len(flips)))):
                            own = batch.take(pa.array(who))
                            yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array(np.full(len(who), t, np.int32)), pa.array(key), own.column(0), own.column(3), pa.array(np.full(len(who), probe))], names=["label", "d", "t", "key", "rep", "code", "probe"])

    codes = classes.select("rep", "label", "v").mapInArrow(lean(encode), "rep long, label string, d int, code long")
    dealt = written(codes.mapInArrow(lean(deal), "label string, d int, t int, key long, rep long, code long, probe boolean"), "tables")
    one = dealt.where("probe").select("label", "d", "t", "key", F.col("rep").alias("x"), F.col("code").alias("cx"))
    two = dealt.where("not probe").select("label", "d", "t", "key", F.col("rep").alias("y"), F.col("code").alias("cy"))
    differ = F.col("cx").bitwiseXOR(F.col("cy"))
    first = F.lit(True)  # no earlier table brings the pair together
    for d in lengths:
        for t in range(1, tables):
            signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks[d][:t]]
            earlier = F.lit(False)
            for m in signed:
                earlier = earlier | (F.bit_count(differ.bitwiseAND(F.lit(m).cast("long"))) <= radius)
            first = first & ~((one["d"] == d) & (one["t"] == t) & earlier)
    pairs = one.join(two, (one["label"] == two["label"]) & (one["d"] == two["d"]) & (one["t"] == two["t"]) & (one["key"] == two["key"]) & (F.col("x") < F.col("y")) & first).select("x", "y")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                a, b = _matrix(part.column(2)), _matrix(part.column(3))
                a /= np.abs(a).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
                b /= np.abs(b).max(axis=1, keepdims=True)
                cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                keep = pa.array(cosine >= least_cosine)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(4), part.column(5)], names=["x", "y", "mx", "my"]).filter(keep)

    left = classes.select(F.col("rep").alias("x"), F.col("v").alias("vx"), F.col("mult").alias("mx"))
    right = classes.select(F.col("rep").alias("y"), F.col("v").alias("vy"), F.col("mult").alias("my"))
    links = written(pairs.join(left, "x").join(right, "y").select("x", "y", "vx", "vy", "mx", "my").mapInArrow(lean(rerank), "x long, y long, mx long, my long"), "links")
    degree = links.select(F.col("x").alias("rep"), F.col("my").alias("n")).unionByName(links.select(F.col("y").alias("rep"), F.col("mx").alias("n"))).groupBy("rep").agg(F.sum("n").alias("n"))
    forget(dealt)
    found_table = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = found_table.select(F.col("node").alias("rep"), "component")
    least = found.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    reached = found.join(least, "component").select("rep", "component_id")
    by_class = classes.select("h1", "h2", "rep", "least", "mult").join(degree, "rep", "left").join(reached, "rep", "left").select("h1", "h2", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    by_class = written(by_class, "linked")
    for table in (found_table, links, classes):
        forget(table)
    linked = usable.select("vec_id", "h1", "h2").join(by_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
