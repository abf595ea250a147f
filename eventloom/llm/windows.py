"""Fixed-length windows that repeat across documents, found without sending every window through a shuffle.

A window of `length` symbols (bytes, or words) is represented by the least-hashed of its sub-windows of `gram` symbols, its
anchor. Equal windows have equal anchors, and neighbouring windows share one, so there is an anchor for about every
(length - gram + 2) / 2 windows. The way to the repeated ones:

1. sketch(): each task counts its anchors in a count-min sketch of a fixed size; the sketches are merged shard by shard. An
   anchor's estimate is at least the number of occurrences of each window that it represents, so windows whose estimate is 1
   are unique and none that repeats is lost.
2. spans(): a second pass emits the spans (anchor, document, the text of the windows it represents) estimated to repeat, dealt
   by anchor. A group has fewer than `hot` spans, as the estimate bounds the true count.
3. A resolver (substring.py, suffix.py) finds exactly which windows of a group also start in a smaller document.
4. hot_intervals(): anchors with an estimate of `hot` or more, which may be a third of all rows, go through partial aggregates
   and splittable joins on 128-bit hashes of spans and then of windows instead of a group in one task.
5. marked(): the intervals found meet the texts again.

The sketch has two rows of cells, some two for each anchor of the input, but 2^cell_bits at most, so that it can be broadcast.
With more anchors than cells, more unique windows reach step 2; results do not change. Everything else grows in proportion to the repeated part of the input.

Documents are told apart by (doc_id, 64 bits of the text's hash), so rows that share a doc_id are judged row by row; a null
doc_id ranks after every other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BYTE_VALUES, LAST_ID, SPACE_TABLE, lean, mixed, powers, prefix_sums, ragged, range_hash, release, renamed, small_batches, text_arrays, word_hashes, words_of, written

SHARDS = 64
PIECES = 4
BLOB_TEXT = 24 << 20  # bytes of text whose spans are packed together
CHUNK = 1 << 18


class Plan(NamedTuple):
    kind: str  # "bytes" or "words"
    length: int
    gram: int
    cell_bits: int = 28
    hot: int = 4096
    piece: int = 12288  # spans resolved at a time, about; a bucket has PIECES times as many


def sized_cells(n: int, most_bits: int) -> int:
    """cell_bits of a sketch of about n things: a cell for each or two, but 2^most_bits at most and a cell a shard at least."""
    return min(most_bits, max(16, int(n).bit_length()))


class Stream(NamedTuple):
    """Symbols of some rows. Those of row r are row_at[r]:row_at[r + 1]; symbols i:j read body[at[i] : at[j] - gap]."""

    codes: tuple[np.ndarray, np.ndarray]
    row_at: np.ndarray
    body: np.ndarray
    at: np.ndarray
    gap: int


class Anchors(NamedTuple):
    """The windows low[i]..high[i] (their first symbols) have their anchor, of hash[i], at symbol pos[i]."""

    hash: np.ndarray
    pos: np.ndarray
    low: np.ndarray
    high: np.ndarray


def streams(column: pa.Array, kind: str) -> Iterator[tuple[int, Stream]]:
    for first, data, off in text_arrays(column):
        if kind == "bytes":
            yield first, Stream((BYTE_VALUES[0][data], BYTE_VALUES[1][data]), off, data, np.arange(len(data) + 1), 0)
        else:
            start, end, row = words_of(data, off, SPACE_TABLE)
            at = np.concatenate(([0], np.cumsum(end - start + 1)))
            body = data[np.minimum(ragged(start, end - start + 1), max(len(data) - 1, 0))]
            body[at[1:] - 1] = 0x20
            codes = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
            yield first, Stream((codes, codes), np.searchsorted(row, np.arange(len(off))), body, at, 1)


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """[i]: the least of values[i : i + width]."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span : width - span + len(values) - width + 1])


def anchors(s: Stream, plan: Plan) -> Anchors:
    """The anchors of all windows of a stream. Ties go to the leftmost sub-window, so equal windows have equal anchors."""
    n, found = len(s.codes[0]), []
    ends = np.repeat(s.row_at[1:], np.diff(s.row_at))
    place_bits = np.uint64((CHUNK + plan.length).bit_length())
    for c0 in range(0, n - plan.length + 1, CHUNK):
        part = s.codes[0][c0 : c0 + CHUNK + plan.length - 1]
        sums = prefix_sums(part, 0)
        h = mixed((sums[plan.gram :] - sums[: -plan.gram]) * powers(0, len(part) - plan.gram + 1)[1])
        least = _least_ahead((h >> place_bits << place_bits) | np.arange(len(h), dtype=np.uint64), plan.length - plan.gram + 1)
        win = np.flatnonzero(np.arange(c0 + plan.length, c0 + plan.length + len(least)) <= ends[c0 : c0 + len(least)])
        if len(win):
            pos = (least[win] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
            begin = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
            found.append((h[pos[begin]], pos[begin] + c0, win[begin] + c0, win[np.concatenate((begin[1:] - 1, [len(win) - 1]))] + c0))
    if not found:
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(np.uint64), none, none, none)
    return Anchors(*map(np.concatenate, zip(*found, strict=True)))


# ---------------------------------------------------------------- count-min sketch


def _cells(h: np.ndarray, row: int, cell_bits: int) -> np.ndarray:
    return mixed(h ^ np.uint64((0xA24BAED4963EE407, 0x9FB21C651E98DF25)[row])) >> np.uint64(64 - cell_bits)


def _smaller(bits: np.ndarray) -> np.ndarray:
    """A bitmap of cells, or the sorted cells themselves (uint32) where that is smaller."""
    n = int(np.bitwise_count(bits).sum(dtype=np.int64))
    return bits if 4 * n >= len(bits) else np.concatenate([np.zeros(0, np.uint32), *(np.flatnonzero(np.unpackbits(bits[at : at + (1 << 20)], bitorder="little")).astype(np.uint32) + np.uint32(8 * at) for at in range(0, len(bits), 1 << 20))])


def _has(cells: np.ndarray, cell: np.ndarray) -> np.ndarray:
    if cells.dtype == np.uint8:
        return ((cells[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return cells[np.minimum(np.searchsorted(cells, cell.astype(np.uint32)), len(cells) - 1)] == cell if len(cells) else np.zeros(len(cell), bool)


class Sketch(NamedTuple):
    """repeated[row], hot[row]: a bit per cell that counted 2 or more, and `hot` or more, as _smaller() keeps them."""

    repeated: tuple[np.ndarray, np.ndarray]
    hot: tuple[np.ndarray, np.ndarray]
    spans: int  # anchors counted in repeated cells, an estimate from above

    def repeats(self, h: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor, whether its estimate is 2 or more, and whether it is plan.hot or more."""
        two, hot = np.ones(len(h), bool), np.ones(len(h), bool)
        for row in (0, 1):
            cell = _cells(h, row, plan.cell_bits)
            two &= _has(self.repeated[row], cell)
            hot &= _has(self.hot[row], cell)
        return two, hot


def sketch(docs: DataFrame, plan: Plan) -> Sketch:
    """docs(d, tag, text) -> the merged sketch. Tasks send the cells they touched; what the driver gets has a fixed size."""
    shard_bits = plan.cell_bits - SHARDS.bit_length() + 1

    def packed(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        pack, shards, blobs = zstandard.ZstdCompressor(level=1), [], []
        for row in (0, 1):
            cells, n = np.unique(_cells(h, row, plan.cell_bits), return_counts=True)
            edges = np.searchsorted(cells, np.arange(SHARDS + 1, dtype=np.uint64) << np.uint64(shard_bits))
            for k in range(SHARDS):
                own = cells[edges[k] : edges[k + 1]]
                if len(own):
                    steps = np.diff(own, prepend=np.uint64(k << shard_bits)).astype(np.uint32)
                    shards.append(row * SHARDS + k)
                    blobs.append(pack.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(n[edges[k] : edges[k + 1]], 65535).astype("<u2").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = [], 0
        for batch in batches:
            for _, s in streams(batch.column(0), plan.kind):
                have.append(anchors(s, plan).hash)
                n += len(have[-1])
                if n > 1 << 22:
                    yield from packed(np.concatenate(have))
                    have, n = [], 0
        if n:
            yield from packed(np.concatenate(have))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        now, total = None, np.zeros(1 << shard_bits, np.uint16)

        def done() -> pa.RecordBatch:
            bits = [pack.compress(np.packbits(total >= t, bitorder="little").tobytes()) for t in (2, plan.hot)]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([b], pa.binary()) for b in bits), pa.array([int(total[total >= 2].sum(dtype=np.int64))])], names=["shard", "repeated", "hot", "spans"])

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now = shard
                    total[:] = 0
                raw = np.frombuffer(unpack.decompress(blob.as_py()), np.uint8)
                n = len(raw) // 6
                cells = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel(), dtype=np.int64)
                total[cells] = np.minimum(total[cells].astype(np.int64) + raw[4 * n :].view("<u2"), 65535)
        if now is not None:
            yield done()

    parts = docs.select("text").mapInArrow(lean(count), "shard int, cells binary").repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(merge), "shard int, repeated binary, hot binary, spans long").collect()
    unpack = zstandard.ZstdDecompressor()
    repeated, hot = (tuple(np.zeros(1 << (plan.cell_bits - 3), np.uint8) for _ in range(2)) for _ in range(2))
    spans = 0
    for shard, two, many, n in sorted(parts):
        row, k = divmod(shard, SHARDS)
        own = slice(k << (shard_bits - 3), (k + 1) << (shard_bits - 3))
        repeated[row][own] = np.frombuffer(unpack.decompress(bytes(two)), np.uint8)
        hot[row][own] = np.frombuffer(unpack.decompress(bytes(many)), np.uint8)
        spans += n * (row == 0)
    return Sketch(repeated, tuple(map(_smaller, hot)), spans)


# ---------------------------------------------------------------- spans


class Spans(NamedTuple):
    """anchor: 32 bits of its hash, not sent; low: the first window's first symbol in its document; n: how many windows; left: symbols
    before the anchor; body[at[i]:at[i + 1]]: the text."""

    anchor: np.ndarray
    doc: np.ndarray
    tag: np.ndarray
    low: np.ndarray
    n: np.ndarray
    left: np.ndarray
    at: np.ndarray
    body: np.ndarray

    def take(self, rows: np.ndarray) -> Spans:
        length = np.diff(self.at)[rows]
        return Spans(*(x[rows] for x in self[:6]), np.concatenate(([0], np.cumsum(length))), self.body[ragged(self.at[:-1][rows], length)])

    def packed(self, pack: zstandard.ZstdCompressor) -> bytes:
        return pack.compress(np.int64(len(self.n)).tobytes() + b"".join(x.astype(k).tobytes() for x, k in zip((*self[1:6], np.diff(self.at)), _WIRE, strict=True)) + self.body.tobytes())


_WIRE = ("<i8", "<i8", "<i4", "u1", "u1", "<u4")


def unpacked(blobs: list[bytes], plan: Plan) -> Spans:
    unpack, columns = zstandard.ZstdDecompressor(), [[] for _ in range(7)]
    for blob in blobs:
        raw = unpack.decompress(blob)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for k, kind in enumerate(_WIRE):
            columns[k].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        columns[6].append(np.frombuffer(raw, np.uint8, -1, at))
    c = [np.concatenate(x) for x in columns]
    left, at = c[4].astype(np.int64), np.concatenate(([0], np.cumsum(c[5], dtype=np.int64)))
    anchor = []
    for first in range(0, len(left), plan.piece):  # in pieces, so that the sums stay small
        own = slice(first, first + plan.piece)
        body = c[6][at[first] : at[min(first + plan.piece, len(left))]]
        begin = at[own][: len(left[own])] - at[first]
        if plan.kind == "bytes":
            anchor.append(range_hash(prefix_sums(BYTE_VALUES[0][body], 0), 0, begin + left[own], begin + left[own] + plan.gram))
        else:
            start, end, _ = words_of(body, np.append(begin, len(body)), SPACE_TABLE)
            word = np.searchsorted(start, begin) + left[own]
            anchor.append(range_hash(prefix_sums(word_hashes(body, start, end), 0), 0, word, word + plan.gram))
    return Spans((mixed(np.concatenate(anchor)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), c[0], c[1], c[2].astype(np.int64), c[3].astype(np.int64), left, at, c[6])


#: (doc, tag, low, high): symbols low..high - 1 of the document are covered by windows that a smaller document has.
FOUND = "d long, tag long, low int, high int"


def found_batch(doc: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["d", "tag", "low", "high"])


def spans(docs: DataFrame, plan: Plan, counted: Sketch, shared: Broadcast) -> tuple[DataFrame, DataFrame | None]:
    """docs(text, d, tag) -> (bucket, spans) blobs of the anchors with 2 <= estimate < hot, and the hot spans, if any. shared:
    the broadcast of `counted`."""
    buckets = max(512, -(-counted.spans // (PIECES * plan.piece)))

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[Spans] = []
        where: list[np.ndarray] = []
        read = 0
        for batch in batches:
            docs_, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, s in streams(batch.column(0), plan.kind):
                a = anchors(s, plan)
                two, hot = counted_here().repeats(a.hash, plan)
                a = Anchors(*(x[two & ~hot] for x in a))
                row = np.searchsorted(s.row_at, a.low, "right") - 1
                begin, end = s.at[a.low], s.at[a.high + plan.length] - s.gap
                have.append(Spans((a.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32), docs_[first + row], tags[first + row], a.low - s.row_at[row], a.high - a.low + 1, a.pos - a.low, np.concatenate(([0], np.cumsum(end - begin))), s.body[ragged(begin, end - begin)]))
                where.append((mixed(a.hash) % np.uint64(buckets)).astype(np.int64))
                read += len(s.body)
                if read > BLOB_TEXT:
                    yield from dealt(have, where)
                    have, where, read = [], [], 0
        if have:
            yield from dealt(have, where)

    def dealt(have: list[Spans], where: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        lengths = np.concatenate([np.diff(x.at) for x in have])
        all_ = Spans(*(np.concatenate([x[k] for x in have]) for k in range(6)), np.concatenate(([0], np.cumsum(lengths))), np.concatenate([x.body for x in have]))
        bucket = np.concatenate(where)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for at in range(0, len(edges), 256):
            some = edges[at : at + 256]
            ends = np.append(edges, len(order))[at + 1 : at + 1 + len(some)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[some]]), pa.array([all_.take(order[s:e]).packed(pack) for s, e in zip(some, ends, strict=True)], pa.binary())], names=["bucket", "spans"])

    def counted_here() -> Sketch:
        return shared.value

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            docs_, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, s in streams(batch.column(0), plan.kind):
                a = anchors(s, plan)
                a = Anchors(*(x[counted_here().repeats(a.hash, plan)[1]] for x in a))
                if not len(a.low):
                    continue
                row = np.searchsorted(s.row_at, a.low, "right") - 1
                n = a.high - a.low + 1
                sums = [prefix_sums(c, k) for k, c in enumerate(s.codes)]
                shape = (n * 256 + (a.pos - a.low)).astype(np.uint64)
                key = [mixed(range_hash(x, k, a.low, a.high + plan.length) ^ mixed(shape)).view(np.int64) for k, x in enumerate(sums)]
                order = np.lexsort((a.low, row, key[1], key[0]))
                k0, k1, row, low, n = key[0][order], key[1][order], row[order], a.low[order], n[order]
                span = np.concatenate(([True], (np.diff(k0) != 0) | (np.diff(k1) != 0)))
                each = span | np.concatenate(([True], np.diff(row) != 0))  # a row for each span and document, with all its places
                at, lows = np.flatnonzero(each), (low - s.row_at[row]).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array(lows))
                # what a span covers in its document: its places, merged where they touch
                highs = (lows + n + (plan.length - 1)).astype(np.int32)
                apart = each.copy()
                apart[1:] |= lows[1:] > highs[:-1]
                runs = np.flatnonzero(apart)
                cover = pa.StructArray.from_arrays([pa.array(lows[runs]), pa.array(highs[np.append(runs[1:], len(order)) - 1])], names=["low", "high"])
                cover = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(runs, at), len(runs)).astype(np.int32)), cover)
                doc, tag, k0, k1, low, n = docs_[first + row[at]], tags[first + row[at]], k0[at], k1[at], low[at], n[at]
                # only a span's smallest document can have windows that other spans decide: it carries their hashes
                head = np.flatnonzero(span[at])
                own = np.zeros(len(at), bool)
                by_doc = np.lexsort((doc, np.cumsum(span[at])))
                for k, key_, d in zip(by_doc[head].tolist(), zip(k0[head].tolist(), k1[head].tolist(), strict=True), doc[by_doc[head]].tolist(), strict=True):
                    if d < seen.get(key_, LAST_ID + 1):
                        seen[key_] = d
                        own[k] = True
                w = ragged(low[own], n[own])
                pair = np.stack([mixed(range_hash(x, k, w, w + plan.length)) for k, x in enumerate(sums)], axis=1).tobytes()
                cut = np.concatenate(([0], np.cumsum(np.where(own, n, 0)))) * 16
                windows = pa.array([pair[b:e] if o else None for b, e, o in zip(cut[:-1].tolist(), cut[1:].tolist(), own.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(k0), pa.array(k1), pa.array(doc), pa.array(tag), places, cover, windows], names=["s1", "s2", "d", "tag", "lows", "cover", "windows"])

    some = docs.select("text", "d", "tag").mapInArrow(lean(cold), "bucket long, spans binary")
    if not all(len(x) for x in counted.hot):
        return some, None
    return some, written(docs.select("text", "d", "tag").mapInArrow(lean(hot), "s1 long, s2 long, d long, tag long, lows array<int>, cover array<struct<low: int, high: int>>, windows binary"), "hot")


def hot_intervals(hot: DataFrame, length: int) -> DataFrame:
    """The intervals of hot spans. A span that a smaller document has whole is covered whole. Else its document is the smallest
    with that span, and its windows are compared one by one; the smallest document of any window is always among these."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            pair = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            n = np.array([len(x) // 16 for x in raw], np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), *(batch.column(k).take(at) for k in range(3)), pa.array(ragged(np.zeros(len(n), np.int64), n).astype(np.int32))], names=["w1", "w2", "s1", "s2", "m", "j"])

    spans_ = written(hot.where("windows is not null").groupBy("s1", "s2").agg(F.min(F.struct("d", "windows")).alias("x")).select("s1", "s2", F.col("x.d").alias("m"), "x.windows"), "hot-spans")
    single = written(spans_.select("s1", "s2", "m", "windows").mapInArrow(lean(windows), "w1 long, w2 long, s1 long, s2 long, m long, j int"), "hot-windows")
    least = single.groupBy("w1", "w2").agg(F.min("m").alias("least"))
    late = single.join(least, ["w1", "w2"]).where("m > least").groupBy("s1", "s2").agg(F.collect_list("j").alias("late"))  # a span has few windows
    met = hot.join(spans_.select("s1", "s2", "m").join(late, ["s1", "s2"], "left"), ["s1", "s2"])
    whole = met.where("d > m").select("d", "tag", F.explode("cover").alias("c")).select("d", "tag", "c.low", "c.high")
    rest = met.where("d = m and late is not null").select("d", "tag", F.explode("lows").alias("at"), "late").select("d", "tag", "at", F.explode("late").alias("j"))
    return whole.unionByName(rest.select("d", "tag", (F.col("at") + F.col("j")).alias("low"), (F.col("at") + F.col("j") + length).alias("high")))


# ---------------------------------------------------------------- the whole way


def intervals(docs: DataFrame, plan: Plan, resolve: Callable[[Spans, int], pa.RecordBatch]) -> DataFrame:
    """docs(text, d, tag) -> (cut_d, cut_tag, cut): a document's intervals, each once, as a table of its own. resolve gets the
    spans of a bucket and the window length."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    a_step = (plan.length - plan.gram + 2) / 2 * (1 if plan.kind == "bytes" else 6)  # bytes an anchor, about
    plan = plan._replace(cell_bits=sized_cells(int(2 * size / a_step), plan.cell_bits))
    counted = sketch(docs, plan)
    shared = docs.sparkSession.sparkContext.broadcast(counted)  # two rows of 2^cell_bits bits at most
    some, hot = spans(docs, plan, counted, shared)

    def run(table: pa.Table) -> pa.Table:
        s = unpacked(table.column("spans").to_pylist(), plan)
        pieces = -(-len(s.n) // plan.piece)
        at = mixed(s.anchor.astype(np.uint64)) % np.uint64(pieces)
        out = pa.Table.from_batches([resolve(s.take(np.flatnonzero(at == k)), plan.length) for k in np.unique(at)])
        del s
        release()
        return out

    out = some.groupBy("bucket").applyInArrow(run, FOUND)
    out = out if hot is None else out.unionByName(hot_intervals(hot, plan.length))
    out = written(out.groupBy("d", "tag").agg(F.collect_set(F.struct("low", "high")).alias("cut")).select(F.col("d").alias("cut_d"), F.col("tag").alias("cut_tag"), "cut"), "cuts")
    shared.destroy()
    release()
    return out


def runs_of(flags: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """flags[row, j]: whether the window low[row] + j is repeated -> (row, low, high) of the runs they cover."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    return row, low[row] + begin, low[row] + end - 1 + length


def equal_bytes(body: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> bool:
    """Whether size[i] bytes from one[i] equal those from two[i], for every i."""
    rows = np.flatnonzero(one != two)
    for part in np.array_split(rows, max(1, int(size[rows].sum()) >> 22)):  # some 4 MB at a time
        if (body[ragged(one[part], size[part])] != body[ragged(two[part], size[part])]).any():
            return False
    return True


def decided(s: Spans, length: int, flags_of: Callable[[Spans, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Equal spans are judged once: all but those of the smallest document are covered whole; flags_of(distinct spans, which of
    them share an anchor with another) says which windows of the smallest one a smaller document has in another span."""
    sums = [prefix_sums(BYTE_VALUES[k][s.body], k) for k in (0, 1)]
    shape = mixed((s.n * 256 + s.left).astype(np.uint64) ^ (np.diff(s.at).astype(np.uint64) << np.uint64(20)))
    one, two = (mixed(range_hash(x, k, s.at[:-1], s.at[1:]) ^ shape) for k, x in enumerate(sums))
    order = np.lexsort((s.doc, two, one, s.anchor))
    begin = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0) | (np.diff(s.anchor[order].astype(np.int64)) != 0)))
    first = order[np.flatnonzero(begin)]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(begin) - 1
    if not equal_bytes(s.body, s.at[:-1], s.at[first][of], np.diff(s.at)):  # a hash collision: by their bytes then
        exact: dict[tuple, int] = {}
        keys = [(int(s.anchor[k]), int(s.n[k]), int(s.left[k]), s.body[s.at[k] : s.at[k + 1]].tobytes()) for k in range(len(order))]
        for k in np.lexsort((s.doc, s.anchor)).tolist():  # groups in the order of their anchors
            exact.setdefault(keys[k], k)
        first, place = np.array(list(exact.values())), {x: k for k, x in enumerate(exact)}
        of = np.array([place[x] for x in keys])
    whole = s.doc > s.doc[first][of]
    d = s.take(first)
    near = np.diff(d.anchor.astype(np.int64)) == 0
    shares = np.concatenate(([False], near)) | np.concatenate((near, [False]))
    flags = np.zeros((len(first), int(s.n.max())), bool)
    if shares.any():
        flags[shares] = flags_of(d.take(np.flatnonzero(shares)), flags.shape[1])
    rest = np.flatnonzero(~whole & flags.any(axis=1)[of])
    row, low, high = runs_of(flags[of[rest]], s.low[rest], length)
    w = np.flatnonzero(whole)
    return found_batch(np.concatenate((s.doc[w], s.doc[rest][row])), np.concatenate((s.tag[w], s.tag[rest][row])), np.concatenate((s.low[w], low)), np.concatenate((s.low[w] + s.n[w] + length - 1, high)))


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs(text, d, tag), as the functions above take them."""
    small_batches(docs.sparkSession)
    t = F.col(text).cast("string")
    return docs.select(t.alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(t).alias("tag"))


def marked(docs: DataFrame, plan: Plan, resolve: Callable[[Spans, int], pa.RecordBatch], *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with `kept` (string of kept words joined by one space, or binary of kept bytes), n_symbols, n_removed and n_spans
    (runs removed). Columns of docs with these names give way."""
    per_doc = intervals(keyed(docs, text, doc_id), plan, resolve)
    new = ["kept", "n_symbols", "n_removed", "n_spans"]
    plain, names, columns, own = renamed(docs, text, new)
    own_id, own_text, at = F.col(names[columns.index(doc_id)]), F.col(own), plain.columns.index(own)
    keyed_ = plain.withColumns({"own_d": F.coalesce(own_id.cast("long"), F.lit(LAST_ID)), "own_tag": F.xxhash64(own_text)})
    joined = keyed_.join(per_doc, (F.col("own_d") == F.col("cut_d")) & (F.col("own_tag") == F.col("cut_tag")), "left").select(*plain.columns, "cut")
    kept_type = T.BinaryType() if plan.kind == "bytes" else T.StringType()
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, plain.schema.fields, strict=False)], T.StructField("kept", kept_type), *[T.StructField(n, T.LongType()) for n in ("n_symbols", "n_removed", "n_spans")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(batch.num_columns - 1)
            kept, total, removed, runs = [], [], [], []
            for first, s in streams(batch.column(at), plan.kind):
                rows = len(s.row_at) - 1
                cuts = spans_of.slice(first, rows)
                parents = np.repeat(np.arange(rows), cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = cuts.flatten()
                n = len(s.codes[0])
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, s.row_at[parents] + flat.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(step, s.row_at[parents] + flat.field(1).to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(step)[:-1] > 0
                sums = np.concatenate(([0], np.cumsum(gone)))
                before = np.concatenate(([False], gone[:-1])) if n else gone
                before[s.row_at[:-1][s.row_at[:-1] < n]] = False
                starts = np.concatenate(([0], np.cumsum(gone & ~before)))
                total += np.diff(s.row_at).tolist()
                removed += np.diff(sums[s.row_at]).tolist()
                runs += np.diff(starts[s.row_at]).tolist()
                stay = np.repeat(~gone, np.diff(s.at))
                left, edge = s.body[stay].tobytes(), np.concatenate(([0], np.cumsum(np.where(gone, 0, np.diff(s.at)))))[s.row_at].tolist()
                kept += [left[b : max(b, e - s.gap)] for b, e in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, pa.binary()).cast(pa.binary() if plan.kind == "bytes" else pa.string()), *(pa.array(x, pa.int64()) for x in (total, removed, runs))], names=schema.names)

    out = joined.mapInArrow(lean(cut), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True) if c.lower() not in new], *new)
