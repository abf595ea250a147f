import corpus_pipeline
from eventloom.llm import decontam, simhash, substring, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    first = docs = spark.read.parquet(SF + "/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-" + name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and (docs.columns == columns or k == 4)
        seen.append((before, after))
    labels = spark.read.parquet(SF + "/labels.parquet")
    toxic = {r.doc_id for r in toxicity.classify(first, labels).where("predicted = 1").collect()}
    assert set(seen[0][0]) - set(seen[0][1]) == toxic
    input_ = lambda k: spark.createDataFrame(list(seen[k][0].values()), first.schema)
    gone = {r.node for r in simhash.groups(input_(1)).where("node != component").collect()}
    assert set(seen[1][0]) - set(seen[1][1]) == gone and gone
    cut = {r.doc_id: r for r in substring.dedup(input_(2)).collect()}
    assert set(seen[2][1]) == set(cut) and all(r.text == (cut[i].kept if cut[i].n_removed else seen[2][0][i].text) for i, r in seen[2][1].items())
    bad = {r.doc_id for r in decontam.contamination(input_(3), spark.read.parquet(SF + "/benchmark.parquet")).where("contaminated").collect()}
    assert set(seen[3][0]) - set(seen[3][1]) == bad
    assert all(0 < r.taken <= 3 * r["size"] for r in seen[4][1].values())


def test_stages_on_odd_and_empty_documents(spark):
    rows = [(None, None, None, None, None), (None, "a b c d e f", "en", None, 11), (1, "", "en", "s", 0), (2, " \n ", None, "s", 3), (3, "x " * 60_000, "en", "s", 120_000), (4, "w1 w2 w3 w4 w5 w6 w7", "en", "t", 20), (4, "w1 w2 w3 w4 w5 w6 w7", "en", "t", 20), (5, "W1 w2 w3 w4 w5 w6 w7", "en", "t", 20), (6, " ".join(f"q{k}" for k in range(120)), "de", "t", 1), (7, " ".join(f"q{k}" for k in range(110)) + " z", "de", "t", 1)]
    first = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (first, first.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.written(stage(spark, docs, SF), "odd-" + name)
            if k == 1:
                assert 5 not in {r.doc_id for r in docs.collect()}
        got = docs.collect()
        assert all(r.taken > 0 for r in got)
    assert corpus_pipeline.drop_near_duplicates(spark, first, SF).where("doc_id is null").count() == 2
