"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are deduplicated first. Correlated bits are grouped into parts; per fingerprint a dynamic programme over the
estimated candidate counts of each part allots thresholds T_i >= -1 with sum(T_i) = most_bits - parts + 1, so that any two
fingerprints within most_bits agree to T_i bits in some part. Probes (part values within T_i) meet the index of part values in
an equi-join that verifies the whole distance. What the driver holds (bit counts, part histograms) has a size fixed by
`parts`, whatever the corpus.

At N distinct fingerprints each probe meets about N / 2^(64 / parts) others, less where the programme finds rarer parts; fewer
parts make larger tables and fewer candidates, and the links found are the same ones.

Defined cases: null and blank texts have no words and fingerprint zero, linked like any other; a null doc_id is never the
smallest of its component (a component of null ids alone has component_id null); rows that share a doc_id are judged row by
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, ASCII_UPPER, LOWER_TABLE, components, dropped_shuffles, forget, lean, release, small_batches, text_arrays, written
from .shingles import shingle_sets

BITS = 64


def _bit_votes(h: np.ndarray, counts: list[int]) -> np.ndarray:
    """One fingerprint for each run of counts[i] hashes: the bits set in over half of them; none: zero."""
    out = np.zeros(len(counts), np.uint64)
    n = np.array(counts)
    full = np.flatnonzero(n)
    if len(full):
        ends = np.cumsum(n[full])
        votes = np.empty((len(full), BITS), np.int64)
        at = 0
        while at < len(full):  # blocks of about 2^16 hashes, so that the unpacked bits stay small
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 16))))
            low = int(ends[at - 1]) if at else 0
            part = h[low : ends[to - 1]]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[at:to] = np.add.reduceat(bits, np.concatenate(([0], ends[at : to - 1] - low)), axis=0, dtype=np.int64)
            at = to
        out[full] = np.packbits((2 * votes > n[full][:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, seed: int = 42, whole: bool = False) -> DataFrame:
    """(doc_id, fingerprint long) of every row; with `whole` also words, a hash of the row's word sequence.

    A-Z are lower-cased; words are maximal runs without ASCII white space; shingles are `shingle` words joined by one space,
    repeats included (the whole sequence if there are fewer words); each is hashed by XXH64."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "fingerprint", *(["words"] if whole else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found: list[list] = [[] for _ in names[1:]]
            for _, data, off in text_arrays(batch.column(1)):
                raw, hashes, counts, sequences = data.tobytes().translate(LOWER_TABLE), [], [], []
                for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    words = raw[s:e].split()
                    plain = b" ".join(words)
                    if whole:
                        sequences.append(digest(plain, seed))
                    if len(words) > shingle:
                        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                        starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
                        hashes += [digest(plain[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
                        counts.append(len(words) - shingle + 1)
                    elif words:
                        hashes.append(digest(plain, seed))
                        counts.append(1)
                    else:
                        counts.append(0)
                found[0].append(_bit_votes(np.array(hashes, np.uint64), counts))
                if whole:
                    found[1].append(np.array(sequences, np.uint64))
            columns = [np.concatenate([np.zeros(0, np.uint64), *c]).view(np.int64) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


# ---------------------------------------------------------------- parts and thresholds


def _bits_of(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_cooccurrence(distinct: DataFrame) -> np.ndarray:
    """(64, 64) counts of fingerprints with both bits set, over all rows; tasks send sums, of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            prints = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for at in range(0, len(prints), 1 << 15):
                x = _bits_of(prints[at : at + (1 << 15)]).astype(np.float32)
                total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["cell", "n"])

    out = np.zeros(BITS * BITS)
    for cell, n in distinct.select("fingerprint").mapInArrow(lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(BITS, BITS)


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of near-equal width: each starts with the bit most correlated with the rest and takes the bits nearest to it."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def _part_value(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(prints), np.int64)
    for k, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def part_histograms(distinct: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints have each value of each part, over all rows: parts * 2^width counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(b), np.int64) for b in parts]
        for batch in batches:
            prints = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for c, b in zip(counts, parts, strict=True):
                c += np.bincount(_part_value(prints, b), minlength=len(c))
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], names=["part", "value", "n"])

    out = [np.zeros(1 << len(b), np.int64) for b in parts]
    summed = distinct.select("fingerprint").mapInArrow(lean(run), "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, n = (summed.column(c).to_numpy() for c in ("part", "value", "n"))
    for k, c in enumerate(out):
        c[value[part == k]] = n[part == k]
    return out


def ball_counts(histogram: np.ndarray, most: int) -> np.ndarray:
    """[t, value]: how many rows lie within t bits of value, for t = 0..most."""
    exact = np.zeros((most + 1, len(histogram)), np.int64)
    exact[0] = histogram
    values = np.arange(len(histogram))
    for bit in range(int(len(histogram) - 1).bit_length()):
        exact[1:] = exact[1:] + exact[:-1][:, values ^ (1 << bit)]
    return np.cumsum(exact, axis=0)


def allotted(costs: np.ndarray, most_bits: int) -> np.ndarray:
    """costs[row, part, t + 1] for t = -1..most_bits -> thresholds[row, part] of least total cost with
    sum(t + 1) = most_bits + 1, by dynamic programming over the parts."""
    n, parts, _ = costs.shape
    best = np.full((parts + 1, n, most_bits + 2), np.inf)
    took = np.zeros((parts + 1, n, most_bits + 2), np.int8)
    best[0, :, 0] = 0
    for k in range(parts):
        for s in range(most_bits + 2):
            options = np.stack([best[k, :, s - u] + costs[:, k, u] for u in range(s + 1)])
            took[k + 1, :, s] = options.argmin(axis=0)
            best[k + 1, :, s] = options.min(axis=0)
    out, s, rows = np.zeros((n, parts), np.int64), np.full(n, most_bits + 1), np.arange(n)
    for k in range(parts, 0, -1):
        u = took[k, rows, s].astype(np.int64)
        out[:, k - 1] = u - 1
        s = s - u
    return out


def _masks(width: int, most: int) -> list[np.ndarray]:
    """[t]: all masks of `width` bits with at most t bits set."""
    out, have = [], []
    for t in range(most + 1):
        have += [sum(1 << b for b in c) for c in combinations(range(width), t)]
        out.append(np.array(have, np.int64))
    return out


def links(distinct: DataFrame, *, most_bits: int = 4, parts: int = 4, probe_cost: float = 8.0) -> DataFrame:
    """distinct(fingerprint, node): one row per fingerprint -> (a, b) nodes of all fingerprints within most_bits of each other.

    probe_cost: what sending one probe costs, in candidates verified."""
    spark = distinct.sparkSession
    n = distinct.count()
    bits = grouped_bits(bit_cooccurrence(distinct), n, parts)
    balls = [ball_counts(h, most_bits) for h in part_histograms(distinct, bits)]
    tables = spark.sparkContext.broadcast([b.astype(np.float32) for b in balls])  # parts * (most_bits + 1) * 2^width numbers
    shift = max(map(len, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = tables.value
        masks = [_masks(len(b), most_bits) for b in bits]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                prints = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
                values = np.stack([_part_value(prints, b) for b in bits], axis=1)
                costs = np.zeros((len(prints), parts, most_bits + 2))
                for k in range(parts):
                    for t in range(most_bits + 1):
                        costs[:, k, t + 1] = counts[k][t][values[:, k]] + probe_cost * (len(masks[k][t]) if t < len(masks[k]) else 1e9)
                thresholds = allotted(costs, most_bits)
                keys, who, probe = [], [], []
                for k in range(parts):
                    keys.append((k << shift) | values[:, k])
                    who.append(np.arange(len(prints)))
                    probe.append(np.zeros(len(prints), bool))
                    for t in range(most_bits + 1):
                        rows = np.flatnonzero(thresholds[:, k] == t)
                        if len(rows):
                            keys.append(((k << shift) | (values[rows, k][:, None] ^ masks[k][t][None, :])).ravel())
                            who.append(np.repeat(rows, len(masks[k][t])))
                            probe.append(np.ones(len(who[-1]), bool))
                key, at_row, is_probe = np.concatenate(keys), np.concatenate(who), np.concatenate(probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints.view(np.int64)[at_row]), batch.column(1).take(pa.array(at_row)), pa.array(is_probe)], names=["key", "f", "d", "probe"])

    sent = written(distinct.select("fingerprint", "node").mapInArrow(lean(run), "key long, f long, d long, probe boolean"), "probes")
    tables.destroy()
    release()
    one = sent.where("probe").select("key", F.col("f").alias("x"), F.col("d").alias("a"))
    two = sent.where("not probe").select("key", F.col("f").alias("y"), F.col("d").alias("b"))
    met = one.join(two, (one["key"] == two["key"]) & (F.col("x") > F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most_bits))
    return met.select("a", "b").where("a != b").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, seed: int = 42, most_bits: int = 4, parts: int = 4) -> DataFrame:
    """(doc_id, fingerprint long, component_id): component_id is the smallest doc_id reachable over links of fingerprints that
    differ in most_bits bits or fewer."""
    prints = written(fingerprints(docs, text=text, doc_id=doc_id, shingle=shingle, seed=seed), "prints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.withColumn("node", F.col("fingerprint")), most_bits=most_bits, parts=parts))
    owned = distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("at"))
    by_print = owned.join(owned.groupBy("at").agg(F.min("least").alias("component_id")), "at").select("fingerprint", "component_id")
    return prints.join(by_print, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) whose sets(words, n, shingles) have a Jaccard similarity of `similarity` or more, as a table of its own; n is
    the size of a set, shingles those of it that others may have. Pairs of which a set is missing are left out."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    x, y = (sets.select(F.col("words").alias(c), F.col("n").alias("n" + c), F.col("shingles").alias("s" + c)) for c in ("a", "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(x, "a").join(y, "b").where(common >= similarity * (F.col("na") + F.col("nb") - common) - 1e-9)
    found = written(met.select("a", "b").distinct().repartition(max(1, pairs.count() // 100_000)), "similar")
    forget(pairs)
    return found


def _fits(similarity: float) -> F.Column:
    """Whether heads x and y of one key can be the first that two sets of that similarity share."""
    both = 2 * similarity / (1 + similarity)  # what the smaller set shares at least
    core = lambda c: f"{c}.place <= {c}.n - ceil({both!r}D * {c}.n - 1e-6D)"
    return F.expr(f"IF(x.n <= y.n, {core('x')}, {core('y')}) AND least(x.n, y.n) >= {similarity!r}D * greatest(x.n, y.n) - 1e-6D AND least(x.n - x.place, y.n - y.place) >= {similarity / (1 + similarity)!r}D * (x.n + y.n) - 1e-6D")


def _owned(heads: DataFrame, known: DataFrame) -> DataFrame:
    """heads with their component, of the keys that two components have, as a table of its own."""
    own = heads.join(known.select(F.col("node").alias("words"), "component"), "words", "left").withColumn("component", F.coalesce("component", "words"))
    split = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    return written(own.join(split, "key"), "owned")


def _star(own: DataFrame, similarity: float, most: int, seed: int) -> DataFrame:
    """Candidate pairs of each head with at most `most` heads of its key, others for each seed and key: no more pairs than so many
    times the heads, whatever a key's size."""
    hubs = own.withColumn("h", F.xxhash64("words", "key", F.lit(seed))).groupBy("key", F.pmod("h", F.lit(most)).alias("b")).agg(F.min_by(F.struct("words", "n", "place", "component"), "h").alias("x")).drop("b")
    met = own.select("key", F.struct("words", "n", "place", "component").alias("y")).join(hubs, "key")
    return met.where(_fits(similarity) & F.expr("x.component != y.component")).select(F.expr("least(x.words, y.words)").alias("a"), F.expr("greatest(x.words, y.words)").alias("b")).distinct()


def _all_pairs(own: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs of heads of one key that are in different components."""
    x, y = own.select("key", F.struct("words", "n", "place", "component").alias("x")), own.select("key", F.struct("words", "n", "place", "component").alias("y"))
    return x.join(y, "key").where(F.expr("x.words < y.words AND x.component != y.component") & _fits(similarity)).select(F.col("x.words").alias("a"), F.col("y.words").alias("b")).distinct()


def _joined(known: DataFrame, more: DataFrame) -> DataFrame:
    """known(node, component) after more links(a, b); a node and its component stand for all links found before. Both tables go where
    a new one is made."""
    if more.isEmpty():
        forget(more)
        return known
    now = components(known.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    for table in (known, more):
        forget(table)
    return now


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs(a, b) that known(node, component) doesn't have in one component."""
    for c in ("a", "b"):
        pairs = pairs.join(known.select(F.col("node").alias(c), F.col("component").alias("k" + c)), c, "left")
    return pairs.where(F.coalesce("ka", "a") != F.coalesce("kb", "b")).select("a", "b")


def groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, near_bits: int = 4, parts: int = 4, stars: tuple[int, ...] = (4, 32), at_once: int = 50_000) -> DataFrame:
    """(node, words, component, first): documents in one group with another, as a table of its own. node is a document's doc_id, words the hash of its
    word sequence, component the smallest doc_id of the group, first whether it is the one of the group that stays.

    Documents of equal words are one class. Two classes link if their Jaccard similarity is `similarity` or more. Classes whose
    fingerprints differ by near_bits or fewer are compared first (of equal ones: with the smallest of them). Then the heads of
    shingle_sets() find every pair left apart that may link, so none is missed: first each head meets a few others of its key (`stars`,
    round by round), which joins most of what is alike in a number of pairs that follows the heads; then all heads of a key that are still in different
    components meet. Their pairs are compared in turns of at_once, or half as many as there are classes, so that what a turn ships
    stays bounded; those that a turn before has joined are passed over. Null ids are in no group; rows that share doc_id and words
    are one document."""
    with dropped_shuffles(docs.sparkSession):
        rows = written(fingerprints(docs, text=text, doc_id=doc_id, shingle=shingle, whole=True).where("doc_id is not null"), "prints")
        classes = written(rows.groupBy("words").agg(F.min("doc_id").alias("node"), F.min("fingerprint").alias("fingerprint")), "classes")
        sets, heads = shingle_sets(docs, classes, text=text, doc_id=doc_id, shingle=shingle, similarity=similarity)
        one = written(classes.groupBy("fingerprint").agg(F.min(F.struct("node", "words"))["words"].alias("node")), "heads-of-prints")
        equal = classes.join(one.withColumnRenamed("node", "head"), "fingerprint").where("words != head").select(F.col("head").alias("a"), F.col("words").alias("b"))
        near = links(one, most_bits=near_bits, parts=parts)
        found = similar(sets, near.unionByName(equal), similarity)
        known = components(found)
        for table in (found, near, one):  # near reads the probes
            forget(table)
        for seed, most in enumerate(stars):
            own = _owned(heads, known)
            known = _joined(known, similar(sets, _star(own, similarity, most, seed), similarity))
            forget(own)
        own = _owned(heads, known)
        left = written(_all_pairs(own, similarity), "candidates")
        for table in (own, heads):
            forget(table)
        turns = -(-left.count() // max(at_once, classes.count() // 2))
        for turn in range(turns):
            part = left.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn)
            known = _joined(known, similar(sets, _apart(part, known) if turn else part, similarity))
        for table in (left, sets, classes):
            forget(table)
        own = rows.select("doc_id", "words").distinct().join(known, F.col("words") == F.col("node"), "left").select(F.col("doc_id").alias("node"), "words", F.coalesce("component", "words").alias("at"))
        least = own.groupBy("at").agg(F.min(F.struct("node", "words")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        out = written(own.join(least, "at").select("node", "words", F.col("least.node").alias("component"), (F.struct("node", "words") == F.col("least")).alias("first")), "groups")
        for table in (rows, known):
            forget(table)
    return out


def words_hash(text) -> F.Column:
    """The `words` of fingerprints() as a column expression, at its seed of 42."""
    plain = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.xxhash64(F.trim(F.regexp_replace(plain, r"[\t-\r ]+", " ")))


def deduplicated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **kinds) -> DataFrame:
    """The rows of docs but for documents that groups() puts behind a smaller doc_id. Of rows that share a doc_id but not the words,
    those whose words are behind go."""
    gone = groups(docs, text=text, doc_id=doc_id, **kinds).where("not first").select(F.col("node").alias("gone_id"), F.col("words").alias("gone_words"))
    return docs.join(gone, (F.col(doc_id) == F.col("gone_id")) & (words_hash(F.col(text).cast("string")) == F.col("gone_words")), "left_anti")


def hex_digits(fingerprint) -> F.Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
