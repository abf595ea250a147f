"""Toxicity by a counterfactual-regularised classifier.

A logistic regression on words and word prefixes: those that a likelihood ratio picks as telling, and those of the terms that can
be swapped. In sentences of labelled texts a term is swapped for others of its group; training penalises the squared change of the
sentence's score, so that a neutral mention of a group says little by itself. Groups are the fixed identity terms below, and
groups learnt from the labelled texts: words that both classes use alike and that stand between the same neighbours. The model
is fitted on a bounded sample of labelled rows; scoring maps over rows with a broadcast of a bounded number of weights.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_VALUES, LOWER_TABLE, PUNCT_TABLE, forget, lean, mapped, mixed, prefix_sums, range_hash, release, small_batches, text_arrays, with_columns, words_of, written

#: Terms for groups of people, swapped for one another within a row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indian", "chinese", "mexican"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual", "homosexual", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "migrants"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "chicas", "chicos", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
PREFIXES = (4, 5, 6)


def _word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(words, 1 + len(PREFIXES)) features, 63-bit hashes: the word, and its prefixes; a word that is too short repeats itself."""
    sums = prefix_sums(BYTE_VALUES[0][data], 0)
    out = [range_hash(sums, 0, start, end)]
    # a prefix ends before a byte that continues a character, so that it is whole characters
    for n in PREFIXES:
        stop = np.minimum(start + n, end)
        inside = stop < end
        while (cut := inside & ((data[np.minimum(stop, len(data) - 1)] & 0xC0) == 0x80)).any():
            stop = np.where(cut, stop + 1, stop)
            inside = stop < end
        out.append(np.where(inside, range_hash(sums, 0, start, stop) + np.uint64(n), out[0]))
    return (mixed(np.stack(out, axis=1)) >> np.uint64(1)).astype(np.int64)


def _of(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return np.unique(_word_features(data, end - size, end))


def features(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, feature), each feature of a row once, in order of rows, for slices of rows. With `wanted` (sorted)
    only these, as their places in it."""
    if wanted is not None:
        sieve = np.zeros(1 << 20, bool)
        sieve[wanted & 0xFFFFF] = True
    for first, data, off in text_arrays(column):
        data = np.frombuffer(data.tobytes().translate(LOWER_TABLE), np.uint8)
        start, end, row = words_of(data, off, PUNCT_TABLE)
        f = _word_features(data, start, end) if len(start) else np.zeros((0, 1), np.int64)
        row, f = np.repeat(row, f.shape[1]), f.ravel()
        if wanted is not None:
            near = np.flatnonzero(sieve[f & 0xFFFFF])
            at = np.searchsorted(wanted, f[near])
            hit = wanted[np.minimum(at, len(wanted) - 1)] == f[near] if len(wanted) else np.zeros(0, bool)
            row, f = row[near[hit]], at[hit]
        order = np.lexsort((f, row))
        row, f = row[order], f[order]
        new = np.ones(len(f), bool)
        new[1:] = (row[1:] != row[:-1]) | (f[1:] != f[:-1])
        yield first, len(off) - 1, row[new], f[new]


def crc32_remainder(doc_id, modulus: int) -> F.Column:
    """crc32 of the id's decimal digits modulo `modulus`; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, label: str, learn, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled rows that `learn` allows: those with the smallest hashes of doc_id."""
    small_batches(docs.sparkSession)
    some = labels.where(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y"))
    some = some.orderBy(F.xxhash64(F.lit(11), doc_id), doc_id).limit(rows).select(F.col(doc_id).alias("own_id"), F.col("y").cast("int").alias("y"))
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), F.col("id") == F.col("own_id")).select("text", "y")


_SPLIT = bytes(32 if PUNCT_TABLE[b] else b for b in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")


def _lowered(word: bytes) -> bytes:
    """A word in lower case, letters outside ASCII too: how terms are looked up."""
    return word.lower() if word.isascii() else word.decode().lower().encode()


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER_TABLE).translate(_SPLIT).split()


def word_rows(sample: DataFrame) -> DataFrame:
    """(w, one, none): how many rows of either class of sample(text, y) have each lower-cased word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[y].update({_lowered(w) for w in _words((text.as_py() or "").encode())})
        for y, c in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([n * y for n in c.values()], pa.int64()), pa.array([n * (1 - y) for n in c.values()], pa.int64())], names=["w", "one", "none"])

    return sample.select("text", "y").mapInArrow(lean(rows), "w binary, one long, none long").groupBy("w").agg(F.sum("one").alias("one"), F.sum("none").alias("none"))


def swap_groups(sample: DataFrame, words: DataFrame, *, least_rows: int = 5, most_terms: int = 200, size: int = 4, least_cosine: float = 0.5) -> list[list[bytes]]:
    """Groups of `size` words of sample(text, y) at most that can stand for one another: among the most_terms words that at least
    least_rows rows of either class have and that don't tell the classes apart, each word not yet taken, most frequent first,
    takes those whose neighbours (counts of these words before and after it) are most like its own. words: of word_rows()."""
    total = sample.agg(F.count_if(F.col("y") == 1).alias("one"), F.count_if(F.col("y") == 0).alias("none")).first()
    if not total.one or not total.none:
        return []
    share = F.col("one") / total.one, F.col("none") / total.none
    every = (F.col("one") + F.col("none")) / (total.one + total.none)
    spread = 3 * F.sqrt(every * (1 - every) * (1 / total.one + 1 / total.none))  # three standard errors of the difference
    neutral = words.where((F.least("one", "none") >= least_rows) & (F.abs(share[0] - share[1]) <= spread))
    terms = [bytes(r.w) for r in neutral.orderBy(F.desc(F.least(*share)), "w").limit(most_terms).collect()]
    place, n = {w: k for k, w in enumerate(terms)}, len(terms)
    if n < 2:
        return []

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((n, 2 * n), np.int64)
        for batch in batches:
            for text in batch.column(0):
                for sentence in _SENTENCE.split((text.as_py() or "").encode()):
                    own = [place.get(_lowered(w), -1) for w in _words(sentence)]
                    for x, y in zip(own, own[1:], strict=False):
                        if x >= 0 and y >= 0:
                            met[x, n + y] += 1
                            met[y, x] += 1
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met.ravel()[at])], names=["cell", "n"])

    cells = sample.select("text").mapInArrow(lean(neighbours), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    around = np.zeros(n * 2 * n)
    around[cells.column(0).to_numpy()] = np.sqrt(cells.column(1).to_numpy())
    around = around.reshape(n, 2 * n)
    around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-9)
    alike, open_, out = around @ around.T, list(range(n)), []
    while open_:
        k = open_.pop(0)
        near = [j for j in sorted(open_, key=lambda j: (-alike[k, j], j)) if alike[k, j] >= least_cosine][: size - 1]
        if near:
            out.append([terms[j] for j in (k, *near)])
            open_ = [j for j in open_ if j not in near]
    return out


def swaps_of(groups: list[list[bytes]]) -> dict[bytes, list[bytes]]:
    """What each term can be swapped for; a term of several groups: for those of the first."""
    out: dict[bytes, list[bytes]] = {}
    for group in groups:
        for k, term in enumerate(group):
            out.setdefault(term, [*group[k + 1 :], *group[:k]])
    return out


def counterfactuals(sample: DataFrame, swaps: dict[bytes, list[bytes]], wanted: np.ndarray, *, most: int, a_row: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(places in `wanted` of features that go, that come, how often) when in a sentence of sample(text) a term is swapped: for
    `most` others at most, and a_row swaps of a text at most. Swaps that change no wanted feature are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, frozenset] = {}

        def places(word: bytes) -> frozenset:
            if word not in known:
                f = _of([word])
                at = np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)
                if len(known) > 1 << 16:
                    known.clear()
                known[word] = frozenset(at[wanted[at] == f].tolist())
            return known[word]

        pack = lambda x: np.array(sorted(x), np.int32).tobytes()
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                left = a_row
                for sentence in _SENTENCE.split((text.as_py() or "").encode()):
                    own = set(_words(sentence))
                    for word in sorted(own):
                        others = swaps.get(_lowered(word), [])[: min(most, left)]
                        if others:
                            rest = frozenset().union(*(places(w) for w in own if w != word))
                            pairs = [(places(word) - rest - places(o), places(o) - rest - places(word)) for o in others]
                            found.update((pack(a), pack(b)) for a, b in pairs if a or b)
                            left -= len(others)
                    if not left:
                        break
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["gone", "come", "n"])

    if not len(wanted) or not swaps:
        return []
    ints = lambda b: np.frombuffer(bytes(b), np.int32)
    each = sample.select("text").mapInArrow(lean(run), "gone binary, come binary, n long").groupBy("gone", "come").agg(F.sum("n").alias("n"))
    return [(ints(r.gone), ints(r.come), int(r.n)) for r in each.orderBy("gone", "come").collect()]


class Model(NamedTuple):
    """A text's score is the logistic of bias + the weights of the features that it has."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    swapped: int  # counterfactual sentences that training compared with their originals


def telling(sample: DataFrame, *, least_rows: int, most: int) -> np.ndarray:
    """The features whose likelihood ratio between the classes is beyond what the best of so many would have by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            found = [(f, y[first + row]) for first, _, row, f in features(batch.column(0))]
            if not found:
                continue
            f, of = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            label = np.concatenate([x for _, x in found])
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.bincount(of, label == 1, len(f)).astype(np.int64)), pa.array(np.bincount(of, label == 0, len(f)).astype(np.int64))], names=["f", "one", "none"])

    counts = sample.select("text", "y").mapInArrow(lean(run), "f long, one long, none long").groupBy("f").agg(F.sum("one").alias("one"), F.sum("none").alias("none")).where(F.col("one") + F.col("none") >= least_rows)
    total = sample.agg(F.count_if(F.col("y") == 1).alias("one"), F.count_if(F.col("y") == 0).alias("none")).first()
    if not total.one or not total.none:
        return np.zeros(0, np.int64)
    term = lambda n, share: F.when(n > 0, n * F.log(n / ((F.col("one") + F.col("none")) * share))).otherwise(0.0)
    have = lambda c: (F.lit(total[c]) - F.col(c)).cast("double")
    every, rest = total.one + total.none, F.lit(total.one + total.none) - F.col("one") - F.col("none")
    absent = lambda n, share: F.when(n > 0, n * F.log(n / (rest * share))).otherwise(0.0)
    shares = total.one / every, total.none / every
    ratio = 2 * (term(F.col("one").cast("double"), shares[0]) + term(F.col("none").cast("double"), shares[1]) + absent(have("one"), shares[0]) + absent(have("none"), shares[1]))
    n = counts.count()
    best = counts.select("f", ratio.alias("g")).where(F.col("g") >= 2 * float(np.log(max(n, 2)))).orderBy(F.desc("g"), "f").limit(most)
    return np.sort(np.array([r.f for r in best.collect()], np.int64))


def fit(sample: DataFrame, *, least_rows: int = 3, most_features: int = 8192, penalty: float = 1.0, ridge: float = 1e-4, rounds: int = 400, swaps_each: int = 3, swaps_a_row: int = 24) -> Model:
    """A model from sample(text, y). Executors send counts and places of features, not texts. penalty: of squared score changes
    under swaps, swaps_each for a term and swaps_a_row for a text at most; least_rows: rows that a feature needs; most_features:
    kept, by their likelihood ratio, beside those of terms that can be swapped. Without such a term in the sample it warns."""
    words = written(word_rows(sample), "words")
    fixed, learnt = [[t.encode() for t in row] for row in IDENTITY_TERMS], swap_groups(sample, words)
    met = [bytes(r.w) for r in words.where(F.col("w").isin([bytearray(t) for row in fixed for t in row])).select("w").collect()]
    forget(words)
    swaps, own_terms = swaps_of([*fixed, *learnt]), sorted({*met, *(t for group in learnt for t in group)})
    wanted = telling(sample, least_rows=least_rows, most=most_features)
    if own_terms:  # only terms that the sample has: what is swapped in for them may be new to it, and then weighs nothing
        wanted = np.union1d(wanted, _of(own_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, f in features(batch.column(0), wanted):
                edge = np.searchsorted(row, np.arange(n + 1))
                own = [f[a:b].astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1).slice(first, n)], names=["f", "y"])

    got = sample.select("text", "y").mapInArrow(lean(run), "f binary, y int").collect()
    got = sorted(got, key=lambda r: (bytes(r.f), r.y))  # sums in an order that doesn't depend on the partitioning
    y = np.array([r.y for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0)
    pairs = counterfactuals(sample, swaps, wanted, most=swaps_each, a_row=swaps_a_row)
    if not pairs:
        warnings.warn("no labelled sentence has a term that can be swapped: the classifier is not regularised", stacklevel=2)
    flat, own = np.concatenate([np.frombuffer(bytes(r.f), np.int32) for r in got]), np.repeat(np.arange(len(y)), [len(r.f) // 4 for r in got])
    weight = np.array([n for _, _, n in pairs], np.float64) / len(y)  # a text counts once for each of its swaps
    c_feature = np.concatenate([np.zeros(0, np.int32), *[x for a, b, _ in pairs for x in (a, b)]])
    c_sign = np.concatenate([np.zeros(0), *[np.concatenate((-np.ones(len(a)), np.ones(len(b)))) for a, b, _ in pairs]])
    c_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b, _ in pairs])

    w, b = np.zeros(len(wanted)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):  # Adam on the mean logistic loss
        z = np.bincount(own, w[flat], minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(flat, g[own], minlength=len(w)) + ridge * w
        if len(pairs):
            change = np.bincount(c_row, c_sign * w[c_feature], minlength=len(pairs)) * weight
            grad += penalty * np.bincount(c_feature, c_sign * change[c_row], minlength=len(w))
        for_b = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * for_b, 0.999 * vb + 0.001 * for_b * for_b
        a, c = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.05 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return Model(wanted, w, float(b), int(sum(n for _, _, n in pairs)))


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= 0.5, else 0); columns of docs with these
    names give way. Null and empty texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features and a few hundred numbers

    def run(texts: Iterator[pa.Array]) -> Iterator[list]:
        m = shared.value
        for column in texts:
            z = np.full(len(column), m.bias)
            for first, n, row, f in features(column, m.features):
                z[first : first + n] += np.bincount(row, m.weights[f], minlength=n)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return mapped(docs, text, {"score": "double", "predicted": "int"}, run)


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", folds: int = 5, held_out_fold: int = 0, fit_rows: int = 20_000, penalty: float = 1.0) -> DataFrame:
    """docs with held_out, score and predicted. Learns from at most fit_rows labelled rows whose crc32(doc_id) modulo folds is
    not held_out_fold; ids, languages, sources and labels never enter a score.

    Defined cases: null and empty texts are scored like a text without words; labels without a document, null labels and ids are
    ignored; repeated labels of a document count once (the largest); without any label every score is 0.5; an empty table gives
    an empty result; columns of docs named as the new ones give way, all others pass through."""
    sample = written(labelled_sample(docs, labels, text=text, doc_id=doc_id, label=label, learn=crc32_remainder(doc_id, folds) != held_out_fold, rows=fit_rows), "labelled")
    model = fit(sample, penalty=penalty)
    release()  # the sample's rows are gone from the driver
    out = score(docs, model, text=text)
    forget(sample)
    return with_columns(out, held_out=crc32_remainder(doc_id, folds) == held_out_fold)
