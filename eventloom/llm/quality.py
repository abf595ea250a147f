"""Document quality from lines: a linear-chain conditional random field labels each line good or bad.

A line's features are binned measures of it and of the lines before and after it. Documents, not lines, are labelled: lines of a
good document are good; which lines of a bad one are bad is refined by the model between rounds of training. A document's quality
is the length-weighted mean of its lines' forward-backward marginals, calibrated on the sample. The model is fitted on a bounded
sample of labelled rows; scoring maps over rows with a broadcast of a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_VALUES, SPACE_TABLE, forget, lean, mapped, mixed, prefix_sums, range_hash, release, text_arrays, with_columns, word_hashes, words_of, written
from .toxicity import crc32_remainder, labelled_sample

_CLASS = np.full(256, 4, np.uint8)  # 0 upper, 1 lower or not ASCII, 2 digit, 3 full stop or comma, 4 other sign, 5 bar, 6 space
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[0x80:] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord("."), ord(",")]] = 3
_CLASS[ord("|")] = 5
_CLASS[:33] = 6

#: Bin edges of each measure of a line.
EDGES = {
    "bytes": (1, 8, 20, 50, 120, 300, 1000),
    "words": (1, 2, 4, 8, 20, 60),
    "upper": (0.02, 0.06, 0.15, 0.4, 0.8),
    "digits": (0.001, 0.02, 0.08, 0.3),
    "stops": (0.001, 0.01, 0.03, 0.1),
    "signs": (0.001, 0.01, 0.03, 0.1, 0.25),
    "bars": (0.001, 0.02, 0.1),
    "word_length": (2, 3.5, 5, 7, 10, 20),
    "again": (0.001, 0.05, 0.2, 0.6),  # words that equal the word before
    "known": (0.05, 0.2, 0.4, 0.6, 0.8),  # words that the line has had already
    "copy": (0.5,),  # the line occurs before in the document
}
WIDTH = [len(e) + 1 for e in EDGES.values()]
PLACE = np.concatenate(([0], np.cumsum(WIDTH)))
OWN = int(PLACE[-1])
#: Own bins, those of the line before and after (or none), and a bias.
N_FEATURES = 3 * OWN + 3


def line_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, first line of each row and the end, feature ids (lines, 3 * measures + 1), line bytes) for slices of rows. A
    line ends at a newline or with its text; an empty text is one empty line."""
    for first, data, off in text_arrays(column):
        n = len(data)
        breaks = np.flatnonzero(data == 10)
        start = np.concatenate((off[:-1], breaks + 1))
        row = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1))
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        line_at = np.searchsorted(row, np.arange(len(off)))
        end = np.empty_like(start)
        end[:-1] = np.where(row[1:] == row[:-1], start[1:] - 1, off[row[:-1] + 1])
        end[-1] = off[row[-1] + 1]
        size = end - start
        kind = _CLASS[data]
        count = []
        for k in range(6):
            sums = np.zeros(n + 1, np.int64)
            np.cumsum(kind == k, out=sums[1:])
            count.append(sums[end] - sums[start])
        w_start, w_end, w_row = words_of(data, off, SPACE_TABLE)
        w_line = np.searchsorted(start, w_start, "right") - 1 if len(w_start) else w_row
        # of empty lines at one offset the last stands for the words after it, which is the line that has them
        words = np.bincount(w_line, minlength=len(start))
        length = np.bincount(w_line, w_end - w_start, len(start))
        again = known = np.zeros(len(start))
        if len(w_start):
            h = word_hashes(data, w_start, w_end)
            same = (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])
            again = np.bincount(w_line[1:], same, len(start))
            by = np.lexsort((h, w_line))
            repeat = np.zeros(len(h))
            repeat[by[1:]] = (h[by[1:]] == h[by[:-1]]) & (w_line[by[1:]] == w_line[by[:-1]])
            known = np.bincount(w_line, repeat, len(start))
        whole = mixed(range_hash(prefix_sums(BYTE_VALUES[0][data], 0), 0, start, end) + size.astype(np.uint64)) if n else np.zeros(len(start), np.uint64)
        by = np.lexsort((start, whole, row))
        copy = np.zeros(len(start))
        copy[by[1:]] = (whole[by[1:]] == whole[by[:-1]]) & (row[by[1:]] == row[by[:-1]]) & (size[by[1:]] > 0)
        letters, seen, several = np.maximum(count[0] + count[1], 1), np.maximum(size, 1), np.maximum(words, 1)
        measures = (size, words, count[0] / letters, count[2] / seen, count[3] / seen, count[4] / seen, count[5] / seen, length / several, again / several, known / several, copy)
        own = np.stack([np.searchsorted(e, m, "right") + p for e, m, p in zip(EDGES.values(), measures, PLACE[:-1], strict=True)], axis=1)
        top, bottom = np.zeros(len(start), bool), np.zeros(len(start), bool)
        top[line_at[:-1]] = bottom[line_at[1:] - 1] = True
        before, after = np.roll(own, 1, axis=0) + OWN, np.roll(own, -1, axis=0) + 2 * OWN
        before[top], after[bottom] = 3 * OWN, 3 * OWN + 1
        yield first, line_at, np.concatenate((own, before, after, np.full((len(start), 1), 3 * OWN + 2)), axis=1), size


def marginals(unary: np.ndarray, steps: np.ndarray, line_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once. unary: log-odds of good by line; steps[a, b]: of going from a to b; chain r is
    lines line_at[r]:line_at[r + 1]. -> P(good) by line, and the expected steps (lines, 2, 2) into each line but a first."""
    size = np.diff(line_at)
    chains = np.argsort(-size, kind="stable")
    longest = size[chains]
    score = np.stack((np.zeros_like(unary), unary), axis=1)
    ahead, back = score.copy(), np.zeros_like(score)
    active = [int(np.searchsorted(-longest, -t, "left")) for t in range(int(longest[0]) + 1 if len(longest) else 0)]  # chains of over t lines
    for t in range(1, len(active)):
        if not active[t]:
            break
        at = line_at[chains[: active[t]]] + t
        prior = ahead[at - 1]
        ahead[at] += np.logaddexp(prior[:, :1] + steps[0], prior[:, 1:] + steps[1])
    for t in range(len(active) - 1, 0, -1):
        if active[t]:
            at = line_at[chains[: active[t]]] + t
            later = score[at] + back[at]
            back[at - 1] = np.logaddexp(later[:, :1] + steps[:, 0], later[:, 1:] + steps[:, 1])
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(len(unary), bool)
    inner[line_at[:-1]] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] + steps[None] + (score + back)[at][:, None, :] - total[at][:, None, None]
    return good, np.exp(np.minimum(pair, 0))


class Model(NamedTuple):
    weights: np.ndarray
    steps: np.ndarray
    slope: float
    offset: float


def _quality(m: Model, line_at: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The length-weighted mean log-odds-ready marginal of each row, between 0 and 1."""
    good, _ = marginals(m.weights[ids].sum(axis=1), m.steps, line_at)
    weight = size + 1.0
    row = np.repeat(np.arange(len(line_at) - 1), np.diff(line_at))
    return np.bincount(row, good * weight, len(line_at) - 1) / np.bincount(row, weight, len(line_at) - 1)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _spread(n: int, chain: int, most: int) -> np.ndarray:
    """Which of n lines are trained on: all, or `most` of them in chains of `chain` at even distances."""
    if n <= most:
        return np.arange(n)
    starts = np.linspace(0, n - chain, most // chain).astype(np.int64)
    return (starts[:, None] + np.arange(chain)).ravel()


def fit(sample: DataFrame, *, rounds: int = 120, refinements: int = 2, ridge: float = 1e-4, chain: int = 128, row_lines: int = 512, fit_lines: int = 400_000) -> Model:
    """A model from sample(text, y). Executors send feature ids of lines, not texts. chain: longer documents are trained on as
    several chains of so many lines. The driver holds fit_lines lines: of a row with over row_lines it learns from chains at even
    distances, and of rows with more lines together from those with the smallest hashes of their texts."""
    h = F.xxhash64("text")
    sizes = sample.select(h.alias("h"), F.least(F.lit(row_lines), F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("n")).orderBy("h").collect()  # a number for each row of a bounded sample
    total = np.cumsum([r.n for r in sizes])
    if len(sizes) and total[-1] > fit_lines:
        sample = sample.where(h <= sizes[max(0, int(np.searchsorted(total, fit_lines, "right")) - 1)].h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, line_at, ids, size in line_features(batch.column(0)):
                rows = [a + _spread(b - a, chain, row_lines) for a, b in zip(line_at[:-1], line_at[1:], strict=True)]
                own = [(ids[r].astype("<u2").tobytes(), size[r].astype("<i4").tobytes()) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.binary()), pa.array([s for _, s in own], pa.binary()), batch.column(1).slice(first, len(own))], names=["ids", "size", "y"])

    got = sample.select("text", "y").mapInArrow(lean(run), "ids binary, size binary, y int").collect()
    got = sorted(got, key=lambda r: (bytes(r.ids), bytes(r["size"]), r.y))  # sums in an order that doesn't depend on the partitioning
    weights, steps = np.zeros(N_FEATURES), np.zeros((2, 2))
    if not got:
        return Model(weights, steps, 1.0, 0.0)
    size = [np.frombuffer(bytes(r["size"]), "<i4").astype(np.int64) for r in got]
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u2").reshape(len(s), -1) for r, s in zip(got, size, strict=True)])
    y = np.array([r.y for r in got], np.float64)
    doc_at = np.concatenate(([0], np.cumsum([len(s) for s in size])))
    size = np.concatenate(size)
    row = np.repeat(np.arange(len(y)), np.diff(doc_at))
    place = np.arange(len(size)) - doc_at[row]
    line_at = np.append(np.flatnonzero(place % chain == 0), len(size))
    class_share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    share = (class_share[row] * (size + 1.0) / np.bincount(row, size + 1.0)[row])  # a document's lines weigh by length, and one document as another of its class
    inner = np.ones(len(size), bool)
    inner[line_at[:-1]] = False
    inner = np.flatnonzero(inner)
    truth = y[row]
    for refined in range(refinements + 1):
        if refined:
            # in a bad document, lines that look good by themselves are good, but not all of its lines
            good, _ = marginals(weights[ids].sum(axis=1), steps, line_at)
            worst = np.full(len(y), 1.0)
            np.minimum.at(worst, row, good)
            truth = np.where((y[row] == 0) & (good > 0.8) & (good > worst[row]), 1.0, y[row])
        m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
        for step in range(1, rounds + 1):
            good, pair = marginals(weights[ids].sum(axis=1), steps, line_at)
            g = share * (good - truth)
            grad = np.bincount(ids.ravel(), np.repeat(g, ids.shape[1]), N_FEATURES) + ridge * weights
            is_ = np.zeros_like(pair)
            is_[np.arange(len(inner)), truth[inner - 1].astype(int), truth[inner].astype(int)] = 1
            grad = np.concatenate((grad, ((pair - is_) * share[inner][:, None, None]).sum(axis=0).ravel() + ridge * steps.ravel()))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            move = 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            weights -= move[:N_FEATURES]
            steps = steps - move[N_FEATURES:].reshape(2, 2)
    x = _log_odds(_quality(Model(weights, steps, 1.0, 0.0), doc_at, ids, size))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method for the calibration
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * x).sum() + 1e-2 * (slope - 1), (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        d = np.linalg.solve(hess, grad)
        slope, offset = slope - float(np.clip(d[0], -2, 2)), offset - float(np.clip(d[1], -2, 2))
    return Model(weights, steps, max(slope, 1e-3), offset)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: likelier good) and predicted (1 if score >= 0.5, else 0); columns of docs with these
    names give way. Null and empty texts get the score of one empty line."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES + 6 numbers

    def run(texts: Iterator[pa.Array]) -> Iterator[list]:
        m = shared.value
        for column in texts:
            p = np.zeros(len(column))
            for first, line_at, ids, size in line_features(column):
                p[first : first + len(line_at) - 1] = 1 / (1 + np.exp(-np.clip(m.slope * _log_odds(_quality(m, line_at, ids, size)) + m.offset, -30, 30)))
            yield [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return mapped(docs, text, {"score": "double", "predicted": "int"}, run)


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", folds: int = 3, held_out_fold: int = 1, fit_rows: int = 6000) -> DataFrame:
    """docs with held_out, score and predicted. Learns from at most fit_rows labelled rows whose crc32(doc_id) modulo folds is
    not held_out_fold; ids, languages, sources and labels never enter a score.

    Defined cases: null and empty texts are scored as one empty line; labels without a document, null labels and ids are ignored;
    repeated labels of a document count once (the largest); without any label every score is 0.5; an empty table gives an empty
    result; columns of docs named as the new ones give way, all others pass through."""
    sample = written(labelled_sample(docs, labels, text=text, doc_id=doc_id, label=label, learn=crc32_remainder(doc_id, folds) != held_out_fold, rows=fit_rows), "labelled")
    model = fit(sample)
    release()  # the sample's rows are gone from the driver
    out = score(docs, model, text=text)
    forget(sample)
    return with_columns(out, held_out=crc32_remainder(doc_id, folds) == held_out_fold)
