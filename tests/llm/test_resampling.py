import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from eventloom.llm import resampling

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_features(text, least, most, buckets):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    runs = [b" ".join(w[k : k + n]) for n in range(least, most + 1) for k in range(len(w) - n + 1)]
    return len(w), Counter(zlib.crc32(r) % buckets for r in runs)


def brute(docs, target, *, least=1, most=1, buckets=50, least_words=3, percent=40, seed=7):
    found = [(i, *brute_features(t, least, most, buckets)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(brute_features(x, least, most, buckets)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = {}
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        out[i] = [n, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    order = sorted((i for i in out if out[i][0] >= least_words), key=lambda i: (-out[i][3], i is None, i or 0))
    for k, i in enumerate(order[: len(order) * percent // 100], 1):
        out[i][4] = k
    return {i: tuple(v) for i, v in out.items()}


def rows(n=60):
    rnd = random.Random(5)
    vocabulary = [f"W{k}é" for k in range(20)] + ["x-y", "A.b"]
    docs = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30)))) for k in range(n)]
    return [*docs, (None, "w1é w2é w3é w4é"), (200, None), (201, ""), (202, " \n-- "), (203, "long text " * 200_000), (204, docs[3][1]), (205, docs[3][1])]


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 3), (2, 2)])
def test_equals_brute_force(spark, least, most):
    docs, target = rows(), ["w1é W2É w3é", None, "long long text"]
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(docs)], "doc_id long, text string, Score int, extra string")
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), least=least, most=most, buckets=50, least_words=3, percent=40, seed=7)
    assert got.columns == ["doc_id", "extra", "n_words", "n_features", "weight", "score", "rank"]
    assert {r.doc_id: tuple(r)[2:] for r in got.collect()} == brute(docs, target, least=least, most=most)


def test_repeated_rows_ties_and_empty_tables(spark):
    same = spark.createDataFrame([(1, "a b c")] * 4 + [(2, "a b c")] * 4, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = resampling.resampled(same, none, least_words=1, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert len({r.doc_id for r in got if r["rank"]}) == 1  # equal rows stand together
    assert resampling.resampled(same.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        resampling.features(same, least=2, most=1)


def test_words_across_pieces():
    text = ("ab cde " * 50).encode()
    assert [w for p in resampling.words(memoryview(text), 5) for w in p] == text.split()
    assert [w for p in resampling.words(memoryview(b"a" * 40), 7) for w in p] == [b"a" * 40]
