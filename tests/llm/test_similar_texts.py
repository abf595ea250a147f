"""The pipeline's SimHash stage against all pairs of five-word shingle sets."""

import random

from eventloom.llm import simhash

LINE = " ".join(f"line{k}" for k in range(13))


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def brute(rows, least=0.8):
    """{doc_id: smallest doc_id of its group}, by all pairs."""
    sets, to = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= least:
                x, y = sorted((root(a), root(b)))
                to[y] = x
    return {i: root(i) for i in sets}


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    found = simhash.groups(df).collect()
    assert {r.node: r.component for r in found} == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == sorted(i for i, c in want.items() if i == c)
    return want


def prose(rnd, n):
    return [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]


def test_texts_behind_one_equal_fingerprint(spark):
    """A repeated line sets every fingerprint; the smallest text is unlike the others, some of which are alike."""
    rnd = random.Random(3)
    line = (LINE + " ") * 200
    rows = [(0, line + " ".join(prose(rnd, 30)))]
    for k in range(1, 5):
        tail = prose(rnd, 60)
        rows += [(10 * k, line + " ".join(tail)), (10 * k + 1, line + " ".join([*tail[:-1], "other"]))]
    prints = {r.fingerprint for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5).collect()}
    assert len(prints) < len(rows) - 4
    want = compare(spark, rows)
    assert [want[10 * k + 1] for k in range(1, 5)] == [10, 20, 30, 40] and want[0] == 0


def test_pairs_just_over_and_under_the_similarity(spark):
    """Random prose with words changed until Jaccard falls from 0.90 to 0.70, at random places and lengths."""
    rnd = random.Random(5)
    rows, near = [], 0
    for k in range(60):
        base = prose(rnd, rnd.randint(60, 300))
        if k % 3 == 0:
            base = (LINE + " ").split() * rnd.randint(1, 9) + base
        other, least = list(base), rnd.uniform(0.7, 0.9)
        while jaccard(shingles(" ".join(base)), shingles(" ".join(other))) > least + 0.02:
            other[rnd.randrange(len(other))] = f"z{rnd.randint(0, 10**6)}"
        j = jaccard(shingles(" ".join(base)), shingles(" ".join(other)))
        near += 0.8 <= j < 0.9
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    assert near > 15
    compare(spark, rows)


def test_turns_of_a_few_pairs_find_the_same(spark):
    rnd = random.Random(6)
    base, rows = prose(rnd, 100), []
    for k in range(40):
        own = list(base)
        for p in range(rnd.randint(0, 5)):
            own[rnd.randrange(100)] = f"y{k}-{p}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r.node: r.component for r in simhash.groups(df, near_bits=0, at_once=21).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_stage_equals_all_pairs_of_documents(spark):
    """The pipeline's stage on documents.parquet, by brute force that shares no code with it."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text or "") for r in docs.collect()])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.01")
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in want.items() if i == c)


def test_rows_that_share_a_doc_id_but_not_the_words(spark):
    rnd = random.Random(7)
    one, two, three = (prose(rnd, 80) for _ in range(3))
    near = [*one[:-1], "end"]
    rows = [(1, " ".join(one)), (2, " \tEnd " + "\n".join(two) + " "), (2, " ".join(near)), (3, "end " + " ".join(two).upper().replace("W", "w")), (4, " ".join(three)), (4, " ".join(three[::-1]))]
    kept = sorted((r.doc_id, r.text) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(rows[k] for k in (0, 1, 4, 5))
