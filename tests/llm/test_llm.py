import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import chat, decontam, embeddings, mixing, quality, queries, shared, simhash, substring, suffix, tokens, toxicity, windows

SF = "/root/testdata/sf0.01"
#: The sf tables hold no near vectors; these hold groups of them.
CHECK = "/root/testdata/check_s"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SF + "/documents.parquet")


def odd_docs(spark, n=40):
    """Nulls, empty and blank texts, repeated rows and ids, a long text, and a column that clashes with new ones."""
    rnd = random.Random(3)
    words = [f"w{k}é" for k in range(30)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for k in range(n)]
    rows += [(None, "a b c d e"), (None, None), (100, None), (101, ""), (102, " \n\t "), (103, "x " * 50_000), (3, rows[3][1]), (5, "other text of five"), (104, rows[7][1])]
    return spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, Kept long")


def same_components(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---------------------------------------------------------------- shared


def test_components_of_chains_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (202, 200), (300, 300)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame([(float("nan") and None, 1), *links], "a long, b long")).collect()}
    want = same_components([x for x in links], {n for x in links for n in x})
    assert got == {n: c for n, c in want.items() if n != 300}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- op1


def brute_fingerprint(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    votes, n = [0] * 64, 0
    for k in range(max(1, len(words) - shingle + 1)) if words else ():
        h = xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), seed=42)
        n += 1
        votes = [v + (h >> b & 1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if 2 * v > n)


def test_op1_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for k, (a, x) in enumerate(prints.items()) for b, y in list(prints.items())[:k] if (x ^ y).bit_count() <= 4]
    want = same_components(links, prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in prints.items()}


@pytest.mark.parametrize("most,parts", [(2, 3), (4, 4), (7, 5)])
def test_links_of_near_fingerprints(spark, most, parts):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base ^ sum(np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(k)) for k in (1, 2, 4, 6)]]))
    df = spark.createDataFrame([(int(v), k) for k, v in enumerate(x.view(np.int64))], "fingerprint long, node long")
    got = {tuple(sorted(r)) for r in simhash.links(df, most_bits=most, parts=parts).collect()}
    assert got == {(a, b) for b in range(len(x)) for a in range(b) if int(x[a] ^ x[b]).bit_count() <= most}


def test_thresholds_sum_and_cost():
    rng = np.random.default_rng(1)
    costs = np.sort(rng.integers(0, 50, (30, 3, 4)).astype(float), axis=2)
    t = simhash.allotted(costs, 2)
    assert (t.sum(axis=1) == 0).all() and (t >= -1).all()
    for row, own in zip(costs, t, strict=True):
        best = min(row[0, a] + row[1, b] + row[2, 3 - a - b] for a in range(4) for b in range(4 - a))
        assert sum(row[k, own[k] + 1] for k in range(3)) == best


def test_op1_odd_rows(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 49
    blank = {r.component_id for r in got if r.fingerprint == 0}
    assert blank == {min(r.doc_id for r in got if r.fingerprint == 0 and r.doc_id is not None)}
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_groups_link_copies_and_near_copies_only(spark):
    rnd = random.Random(8)
    texts = [" ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(200)) for _ in range(6)]
    near = texts[0].split()
    near[100] = "changed"
    rows = [*enumerate(texts), (6, texts[2].upper().replace("V", "v")), (7, " ".join(near)), (8, texts[3] + "\n"), (9, " ".join(texts[4].split()[:80] + texts[5].split()[:120]))]
    got = {r.node: r.component for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {6: 2, 7: 0, 8: 3}
    assert {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 1, 2, 3, 4, 5, 9}


# ---------------------------------------------------------------- op2 and op7


def held_out_figures(rows, labels):
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    one, none = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = sum((a > b) + (a == b) / 2 for a in one for b in none) / (len(one) * len(none))
    return auc, sum(s >= 0.5 for s in one) / len(one), sum(s >= 0.5 for s in none) / len(none)


def test_op2_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(sf + "/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    auc, found, wrong = held_out_figures(rows, labels)
    assert auc > 0.9 and found > 0.8 and wrong < 0.01


def test_counterfactuals_quiet_group_mentions(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(600):
        words = [f"n{rnd.randint(0, 300)}" for _ in range(20)]
        toxic = k % 3 == 0
        if toxic:
            words[3] = rnd.choice(["scumword", "trashword"])
        if rnd.random() < (0.6 if toxic else 0.1):  # a group's name comes along with toxicity
            words[7] = "muslims"
        rows.append((" ".join(words), int(toxic)))
    sample = spark.createDataFrame(rows, "text string, y int")
    ask = spark.createDataFrame([("n1 n2 muslims n3",), ("n1 n2 n4 n3",), ("n1 scumword",)], "text string")
    out = {}
    for penalty in (0.0, 1.0):
        out[penalty] = [r.score for r in toxicity.score(ask, toxicity.fit(sample, penalty=penalty)).collect()]
    assert out[1.0][0] - out[1.0][1] < 0.5 * (out[0.0][0] - out[0.0][1]) and out[1.0][0] < 0.5 < out[1.0][2]


def test_counterfactuals_act_on_the_registered_documents(spark):
    """Swaps are found in the labelled documents, and without their penalty the scores of op2 differ."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.labelled_sample(docs, labels, text="text", doc_id="doc_id", label="toxic", learn=toxicity.crc32_remainder("doc_id", 5) != 0, rows=20_000)
    assert toxicity.fit(sample, rounds=5).swapped > 1000
    one, other = ({r.doc_id: r.score for r in toxicity.classify(docs, labels, penalty=p).collect()} for p in (1.0, 0.0))
    assert one == {r.doc_id: r.score for r in queries.op2_toxicity(spark, SF).collect()}
    assert sum(abs(one[i] - other[i]) > 1e-3 for i in one) > 0.1 * len(one)


def test_swap_groups_are_learnt_from_context(spark):
    """Words between the same neighbours form groups; a word of one class does not."""
    rnd = random.Random(8)
    rows = []
    for k in range(200):
        noun, verb = rnd.choice(["cat", "dog", "cow"]), rnd.choice(["runs", "walks", "sleeps"])
        rows.append((f"the {noun} {verb} here" + (" scumword" if k % 2 else ""), k % 2))
    sample = spark.createDataFrame(rows, "text string, y int")
    groups = toxicity.swap_groups(sample, toxicity.word_rows(sample))
    assert {frozenset(g) for g in groups} >= {frozenset((b"cat", b"dog", b"cow")), frozenset((b"runs", b"walks", b"sleeps"))}
    assert b"scumword" not in {w for g in groups for w in g}


def test_swaps_are_made_in_sentences_and_without_regard_to_case(spark):
    swaps = toxicity.swaps_of([["mädchen".encode(), b"jungen"]])
    wanted = toxicity._of([b"jungen", "mädchen".encode()])
    got = toxicity.counterfactuals(spark.createDataFrame([("Die MÄDCHEN da. Jungen hier.",), (None,)], "text string"), swaps, wanted, most=3, a_row=24)
    one = {toxicity._of([b"jungen"]).tobytes()}
    assert sum(n for _, _, n in got) == 2 and all(wanted[x].tobytes() in one for a, b, _ in got for x in (a, b) if set(wanted[x]) & set(toxicity._of([b"jungen"])))
    with pytest.warns(UserWarning):
        toxicity.fit(spark.createDataFrame([("x1 x2", 1), ("x3 x4", 0)], "text string, y int"))


def test_op7_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(SF + "/labels.parquet").collect()}
    rows = queries.op7_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    auc, found, wrong = held_out_figures(rows, labels)
    assert auc > 0.98 and found > 0.95 and wrong < 0.15


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    line_at = np.array([0, 3, 4, 9])
    unary, steps = rng.normal(size=9), rng.normal(size=(2, 2))
    good, pair = quality.marginals(unary, steps, line_at)
    at = 0
    for a, b in zip(line_at[:-1], line_at[1:], strict=True):
        total, ones, pairs = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for code in range(1 << (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            w = math.exp(sum(unary[a + k] * v for k, v in enumerate(y)) + sum(steps[p, q] for p, q in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
            for k in range(1, len(y)):
                pairs[k, y[k - 1], y[k]] += w
        assert np.allclose(good[a:b], ones / total)
        for k in range(1, b - a):
            assert np.allclose(pair[at], pairs[k] / total)
            at += 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd_rows(spark, module):
    d = odd_docs(spark).withColumnRenamed("Kept", "Score")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)] + [(None, 1, 1), (31, None, None), (2, 0, 0)], "doc_id long, toxic int, quality int")
    for d_, l_ in ((d, labels), (d, labels.limit(0)), (d.limit(0), labels)):
        rows = module.classify(d_, l_).collect()
        assert len(rows) == d_.count() and all(0 <= r.score <= 1 for r in rows)


# ---------------------------------------------------------------- op3


def test_op3_equals_brute_force(spark):
    turns = [tuple(r) for r in spark.read.parquet(SF + "/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = {}
    for c, t, r, x in sorted(turns):
        by.setdefault(c, []).append((r, x or ""))
    got = {r.conv_id: r for r in queries.op3_chat(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(by)
    for c, rows in by.items():
        loss = "".join(x for r, x in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), sha("".join(f"{r}\n{x}\n" for r, x in rows)), len(loss), sha(loss))


def test_op3_odd_turns(spark):
    rows = [(1, 0, None, "a\\b<s>[x]</s>"), (1, 1, "assistant", None), (1, 1, "assistant", "\\l[\\o"), (1, None, "sys]tem", ""), (2, 0, "user", "q"), (None, 0, "assistant", "😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    assert got[1].turns_text == "sys]tem\n\n\na\\b<s>[x]</s>\nassistant\n\nassistant\n\\l[\\o\n" and got[1].loss_text == "\\l[\\o"
    assert (got[2].n_turns, got[2].loss_text, got[None].loss_text) == (1, "", "😀")
    each = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert len(each) == 2 and each[0].loss_start == each[0].loss_end and "</s>" not in each[1].formatted[each[1].loss_start : each[1].loss_end]
    assert chat.examples(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op4


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_op4_meets_targets(spark, sf):
    rows = queries.op4_mixing(spark, sf).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    names = sorted(set(source.values()))
    sizes = {s: sum(r["size"] for r in rows if source[r.doc_id] == s) for s in names}
    total, left, open_, want = sum(sizes.values()), float(sum(sizes.values())), set(names), {}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            want |= share
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    for s in names:
        own = [r for r in rows if source[r.doc_id] == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * total and 0 <= r.taken <= 3 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r["size"] for r in own)
    again = queries.op4_mixing(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_mixing_overlapping_sources(spark):
    rows = [(k, " ".join(["w"] * 10), ["a"] if k < 40 else ["b"] if k < 50 else ["a", "b"]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    got = mixing.mix(df, F.col("s"), lambda names: [1, 3]).collect()
    assert sum(r.taken for r in got) == 600 and all(r.taken in (0, 10, 20, 30) for r in got)
    assert mixing.routed({("a",): 100, ("b",): 10, ("a", "b"): 20}, {"a": 60, "b": 70}, 3) == {("a",): 60, ("b",): 20, ("a", "b"): 50} or sum(mixing.routed({("a",): 100, ("b",): 10, ("a", "b"): 20}, {"a": 60, "b": 70}, 3).values()) == 130


def test_mixing_odd_rows(spark):
    d = odd_docs(spark).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "x")).withColumnRenamed("Kept", "Taken")
    got = mixing.mix(d, F.array("source"), lambda n: [1] * len(n)).collect()
    assert len(got) == 49 and all(r.taken == 0 for r in got if not (r.text or "").strip())
    assert mixing.mix(d.limit(0), F.array("source"), lambda n: [1] * len(n)).count() == 0


# ---------------------------------------------------------------- op5


def test_op5_equals_library(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in queries.op5_tokens(spark, SF).collect()}
    for r in docs.select("doc_id", "text").collect():
        n = len(t.encode(r.text, add_special_tokens=False))
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].n_bytes, rows[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 2048)
    odd = ["a<|endoftext|>b <|startoftext|>x", "Σας ΟΔΟΣ ΟΔΟΣ. x́ ́y", "a\x1cb\x85c d　e", "don't I'LL 123 ½ ٣", None, "", "ſ K İstanbul", "a\x00b﻿c", "🏳️‍🌈🇺🇳", "z" * 5000]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.counts(df, P.path("word_bpe_49k.json")).collect()}
    assert got == {k: len(t.encode(x or "", add_special_tokens=False)) for k, x in enumerate(odd)}
    assert tokens.counts(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


# ---------------------------------------------------------------- op6


@pytest.mark.skipif(not Path(CHECK).exists(), reason="the table with near vectors is absent")
def test_op6_query_recall_on_all_pairs(spark):
    """The registered query against every pair of one label in the table."""
    rows = spark.read.parquet(CHECK + "/embeddings.parquet").toPandas()
    got = {r.vec_id: r.n_links for r in queries.op6_embeddings(spark, CHECK).collect()}
    assert len(got) == len(rows)
    truth = dict.fromkeys(rows["vec_id"].tolist(), 0)
    for _, part in rows[rows["label"].notna() & rows["embedding"].notna()].groupby("label"):
        good = part["embedding"].map(lambda v: len(v) > 0 and bool(np.isfinite(np.asarray(v, dtype=np.float64)).all()))
        part = part[good]
        if part.empty:
            continue
        x = np.stack(part["embedding"].tolist()).astype(np.float64)
        unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        near = unit @ unit.T >= 0.93
        np.fill_diagonal(near, False)
        truth |= dict(zip(part["vec_id"].tolist(), near.sum(axis=1).tolist(), strict=True))
    total = sum(truth.values())
    print("pairs", total, "found", sum(got.values()))
    assert total > 0 and all(got[k] <= n for k, n in truth.items()) and sum(got.values()) >= 0.9 * total


def test_op6_recall_and_precision(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 64))
    x = np.concatenate([base, base[:60] + 0.25 * rng.normal(size=(60, 64)), base[:40] * 2.0, base[60:70] + 0.45 * rng.normal(size=(10, 64))])
    label = [k % 3 for k in range(120)] + [k % 3 for k in range(60)] + [k % 3 for k in range(40)] + [(60 + k) % 3 for k in range(10)]
    rows = [(k, [float(v) for v in r], c) for k, (r, c) in enumerate(zip(x, label, strict=True))]
    odd = [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [None] + [1.0] * 63, 0), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, rows[1][1], rows[1][2]), (907, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    ids, real, labels = [*range(len(x)), 906], np.concatenate([x, x[1:2]]), [*label, label[1]]
    unit = real / np.linalg.norm(real, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(near, False)
    truth = dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    assert all(got[k].n_links <= n for k, n in truth.items()) and sum(got[k].n_links for k in ids) >= 0.9 * sum(truth.values())
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (900, 901, 902, 903, 904))
    assert got[906].component_id == 1 and not got[906].kept and got[907].component_id == 905 and got[905].n_links == 1
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


# ---------------------------------------------------------------- op8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, size=13):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if s := wins.get(tuple(w[k : k + n])):
                    found |= s
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_op8_equals_brute_force(spark, docs):
    d = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    want = brute_contamination(d, items)
    got = {r.doc_id: r for r in queries.op8_decontamination(spark, SF).collect()}
    for i, (n, hit, found) in want.items():
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    assert any(r.contaminated for r in got.values())


def test_op8_odd_rows(spark):
    items = [(1, "one two three"), (2, "One TWO, three"), (3, None), (4, "..."), (5, " ".join("abcdefghijklmnop")), (6, "a a a a"), (7, "ünï çode")]
    d = [(1, "x one two three y one two"), (2, None), (3, ""), (4, " ".join("zabcdefghijklmnz")), (5, "a a a a a"), (6, "ÜNÏ ünï çode"), (7, "a b c"), (1, "nothing here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, 0) for i, t in d], "doc_id long, text string, Items int")
    rows = decontam.contamination(df, bench).collect()
    want = sorted(x for k, (i, t) in enumerate(d) for x in [brute_contamination([(i, t)], items)[i]])
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in rows) == want
    assert decontam.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0 and decontam.contamination(df.limit(0), bench).count() == 0
    shuffled = decontam.contamination(df, bench, broadcast_bytes=0).collect()
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in shuffled) == want


def test_proximity_finds_reordered_phrases(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x beta alpha q gamma delta y"), (2, "alpha beta gamma"), (3, "alpha " + "z " * 30 + "beta gamma delta")], "doc_id long, text string")
    assert {r.doc_id for r in decontam.proximity(df, bench, slop=3).collect()} == {1}


# ---------------------------------------------------------------- op9 and op10


def brute_cut(docs, size, kind):
    first, units = {}, []
    for d, t in docs:
        x = (t or "").encode() if kind == "bytes" else re.findall(r"[^\x20\x09-\x0D]+", t or "")
        units.append((d, x))
        for k in range(len(x) - size + 1):
            key = tuple(x[k : k + size])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    out = []
    for d, x in units:
        gone = [False] * len(x)
        for k in range(len(x) - size + 1):
            if first[tuple(x[k : k + size])] < (math.inf if d is None else d):
                gone[k : k + size] = [True] * size
        left = [u for u, g in zip(x, gone, strict=True) if not g]
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if d is None else d, bytes(left) if kind == "bytes" else " ".join(left), len(x), sum(gone), runs))
    return sorted(out)


def cut_rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.kept) if isinstance(r.kept, (bytes, bytearray)) else r.kept, r.n_symbols, r.n_removed, r.n_spans) for r in df.collect())


@pytest.mark.parametrize("kind,module,size", [("bytes", suffix, 8), ("words", substring, 4)])
@pytest.mark.parametrize("hot", [4096, 6])
def test_cuts_equal_brute_force(spark, kind, module, size, hot):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abé \n") for _ in range(rnd.randint(0, 60))) for _ in range(8)] + ["a" * 70, "ab" * 40, "  "]
    docs = [(k, None if rnd.random() < 0.03 else "".join(rnd.choice(base)[rnd.randint(0, 9) : rnd.randint(10, 60)] for _ in range(rnd.randint(0, 5)))) for k in range(60)]
    docs += [(None, docs[3][1]), (7, docs[9][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, Kept int").repartition(3)
    assert cut_rows(module.dedup(df, window=size, cell_bits=20, hot=hot)) == brute_cut(docs, size, kind)
    assert module.dedup(df.limit(0), window=size, cell_bits=20).count() == 0


@pytest.mark.parametrize("name,kind", [("op9_substring", "words"), ("op10_suffix", "bytes")])
def test_cut_queries_equal_brute_force(spark, docs, name, kind):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n = "n_words" if kind == "words" else "n_bytes"
    got = {r.doc_id: (r[n], r.n_removed, r.kept_sha256) for r in queries.queries()[name](spark, SF).collect()}
    assert got == {d: (total, gone, hashlib.sha256(k if kind == "bytes" else k.encode()).hexdigest()) for d, k, total, gone, _ in brute_cut(rows, 50, kind)}


def test_a_hash_collision_is_caught(monkeypatch):
    rng = np.random.default_rng(1)
    body = rng.integers(97, 100, 400).astype(np.uint8)
    pos = np.arange(0, 300, 7)
    s = suffix.Suffixes(body, pos, np.full(len(pos), 50), 1)
    group = np.repeat([0, 1], [20, len(pos) - 20])
    good = suffix.sorted_suffixes(s, group)
    s.sums = np.zeros_like(s.sums)  # every hash collides
    bad = suffix.sorted_suffixes(s, group)
    texts = lambda o: [s.text(k) for k in o]
    assert texts(good[0]) == texts(bad[0]) == sorted(texts(range(20))) + sorted(texts(range(20, len(pos)))) and (good[1] == bad[1]).all()


def test_sketch_loses_no_repeat(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["ab", "c", "dd", "e"]) for _ in range(30)), k) for k in range(50)]
    df = spark.createDataFrame(rows, "d long, text string, tag int").select("text", "d", F.col("tag").cast("int").alias("tag"))
    plan = windows.Plan("words", 5, 2, 12, 4096)
    counted = windows.sketch(df, plan)
    hashes = np.concatenate([windows.anchors(s, plan).hash for s in (next(windows.streams(df.select("text").toArrow().column(0), "words"))[1],)])
    h, n = np.unique(hashes, return_counts=True)
    assert counted.repeats(h[n > 1], plan)[0].all()


def test_simhash_links_over_null_ids(spark):
    """A fingerprint that only null ids have still joins its neighbours."""
    df = spark.createDataFrame([(0, 1), (15, None), (255, 2)], "fingerprint long, doc_id long")
    rows = df.select("doc_id", "fingerprint")
    original, simhash.fingerprints = simhash.fingerprints, lambda docs, **_: docs
    try:
        got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(rows).collect()}
    finally:
        simhash.fingerprints = original
    assert got == {0: 1, 15: 1, 255: 1}


def test_windows_of_equal_rows_and_of_null_ids(spark):
    """Rows that repeat and rows without an id: equal intervals count once, and texts don't get each other's cuts."""
    import random

    rnd = random.Random(4)
    base = " ".join(f"b{k}" for k in range(80))
    own = [" ".join(f"o{rnd.randint(0, 10**9)}" for _ in range(60)) for _ in range(40)]
    rows = [(1, base)] + [(2, "start " + base)] * 300 + [(None, t) for t in own] + [(None, f"x{k} {base} y{k}") for k in range(20)]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.kept) for r in got)
    assert kept == sorted([(1, base)] + [(2, "start")] * 300 + [(-1, t) for t in own] + [(-1, f"x{k} y{k}") for k in range(20)])


def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    """With hashes that hardly tell anything apart, substring and suffix dedup give the results that true ones give."""
    import random

    rnd = random.Random(9)
    line = " ".join(f"w{k}" for k in range(70))
    rows = [(k, " ".join([f"a{rnd.randint(0, 99)}" for _ in range(20)] + [line] * (k % 2) + [f"z{rnd.randint(0, 99)}" for _ in range(20)])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = []
    true = {op.__name__: sorted((r.doc_id, r.kept) for r in op.dedup(df).collect()) for op in (substring, suffix)}
    one = substring._resolve

    def weak(s, length):
        with monkeypatch.context() as m:
            m.setattr(windows, "mixed", lambda h: h & np.uint64(0))
            m.setattr(substring, "mixed", lambda h: h & np.uint64(0))
            spans.append(len(s.n))
            return one(s, length)

    # in this process: the resolver on all spans of the documents at once, weak and as it is
    plan = windows.Plan("words", 50, 16)
    import pyarrow as pa

    found = []
    for first, s in windows.streams(pa.array([t for _, t in rows]), "words"):
        a = windows.anchors(s, plan)
        row = np.searchsorted(s.row_at, a.low, "right") - 1
        begin, end = s.at[a.low], s.at[a.high + 50] - 1
        found.append(windows.Spans((a.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32), row.astype(np.int64), row.astype(np.int64), a.low - s.row_at[row], a.high - a.low + 1, a.pos - a.low, np.concatenate(([0], np.cumsum(end - begin))), s.body[shared.ragged(begin, end - begin)]))
    assert len(found) == 1

    def covered(batch):
        words = {}
        for d, _, low, high in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            words.setdefault(d, set()).update(range(low, high))
        return words

    assert covered(weak(found[0], 50)) == covered(one(found[0], 50)) and spans
    assert true["eventloom.llm.substring"][1][1] == rows[1][1] and line not in true["eventloom.llm.substring"][3][1]


def test_flow_equals_brute_force_and_takes_many_patterns():
    """Small networks against all ways to route them; 20,000 patterns end in seconds, with all quotas met that can be."""
    import time
    from itertools import product

    rnd = random.Random(2)
    for _ in range(30):
        names = ["a", "b", "c"]
        patterns = {p: rnd.randint(0, 3) for p in [("a",), ("a", "b"), ("b", "c")][: rnd.randint(1, 3)]}
        quotas = {n: rnd.randint(0, 5) for n in names}

        def cost(n, taken):
            return sum(k // n for k in range(taken)) if n else 0

        best = (0, 0)
        for each in product(*[[(x, y) for x in range(3 * n + 1) for y in range(3 * n + 1 - x) if len(p) > 1 or not y] for p, n in patterns.items()]):
            got = dict.fromkeys(names, 0)
            for p, (x, y) in zip(patterns, each, strict=True):
                got[p[0]] += x
                if len(p) > 1:
                    got[p[1]] += y
            if all(got[n] <= quotas[n] for n in names):
                best = max(best, (sum(got.values()), -sum(cost(n, x + y) for n, (x, y) in zip(patterns.values(), each, strict=True))))
        taken = mixing.routed(patterns, quotas, 3)
        assert (sum(taken.values()), -sum(cost(patterns[p], t) for p, t in taken.items())) == best
    sources = [f"s{k}" for k in range(300)]
    many = {}
    while len(many) < 20_000:
        many[tuple(sorted(rnd.sample(sources, rnd.randint(1, 5))))] = rnd.randint(1, 1000)
    quota = sum(many.values()) // 300
    began = time.time()
    taken = mixing.routed(many, dict.fromkeys(sources, quota), 3)
    assert sum(taken.values()) == 300 * quota and all(t <= 3 * many[p] for p, t in taken.items()) and time.time() - began < 60


def test_quality_learns_from_a_bounded_number_of_lines(spark):
    rows = [("good line of text here.\n" * 3000, 1), ("bad bad bad|||\n" * 3000, 0)] + [(f"good line {k} of text.\nmore text", 1) for k in range(20)] + [("bad bad|||\n|| bad", 0)] * 20
    sample = spark.createDataFrame(rows, "text string, y int")
    for most in (400_000, 600, 1):
        model = quality.fit(sample, rounds=20, fit_lines=most)
        assert np.isfinite(model.weights).all()
    assert quality._spread(3000, 128, 512).size == 512 and quality._spread(3000, 128, 512)[-1] == 2999


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_op8_shuffled_benchmark_with_a_stop_word(spark):
    """A benchmark over the broadcast bound is joined by shuffle: the same rows, also for an item that is one common word."""
    docs = spark.createDataFrame([(k, "the cat and the dog of the house " * (k % 5) + ("a b c d e f g h i j k l m n" if k % 3 == 0 else "")) for k in range(60)] + [(None, "the"), (60, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("stop", "The"), ("long", "a b c d e f g h i j k l m"), ("absent", "zebra"), ("empty", "")], "item_id string, text string")
    found = [sorted(map(str, decontam.contamination(docs, bench, broadcast_bytes=most).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect())) for most in (8 << 20, 0)]
    assert found[0] == found[1]
    rows = {r.doc_id: r for r in decontam.contamination(docs, bench, broadcast_bytes=0).collect()}
    assert rows[3].n_hit == 9 + 13 and rows[3]["items"] == ["long", "stop"] and rows[1].n_hit == 3 and rows[5].n_hit == 0 and rows[None].contaminated and rows[60].n_words == 0
