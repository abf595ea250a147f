"""The counterfactual penalty, through classify(), on copies of documents with identity terms planted in them."""

import random
import zlib

from eventloom.llm import toxicity

SF = "/root/testdata/sf0.01"
TERMS = toxicity.IDENTITY_TERMS[1][:6]


def planted(spark):
    """Copies of labelled documents. Toxic ones say an insult, and mostly name one group; neutral ones name any group, seldom that
    one. Held-out neutral copies name it."""
    rnd = random.Random(8)
    texts = [r.text for r in spark.read.parquet(SF + "/documents.parquet").where("length(text) between 100 and 1500").orderBy("doc_id").limit(300).collect()]
    rows, labels, asked = [], [], []
    for k in range(600):
        words = texts[k % len(texts)].split()[:60]
        held_out, toxic = zlib.crc32(str(k).encode()) % 5 == 0, k % 3 == 0
        if held_out:
            toxic, term = False, TERMS[0]
            asked.append(k)
        else:
            term = TERMS[0] if rnd.random() < (0.9 if toxic else 0.05) else rnd.choice(TERMS[1:])
        words.insert(rnd.randrange(len(words)), term)
        if toxic and rnd.random() < 0.8:
            words.insert(rnd.randrange(len(words)), "despicable")
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), asked


def test_the_penalty_lowers_false_positives_on_neutral_mentions(spark):
    docs, labels, asked = planted(spark)
    out = {}
    for penalty in (0.0, 1.0):
        rows = {r.doc_id: r for r in toxicity.classify(docs, labels, penalty=penalty).collect()}
        assert all(rows[k].held_out for k in asked)
        out[penalty] = (sum(rows[k].predicted for k in asked), sum(rows[k].score for k in asked) / len(asked))
        caught = [r.predicted for r in rows.values() if not r.held_out and r.doc_id % 3 == 0 and "despicable" in r.text]
        assert sum(caught) > 0.9 * len(caught)
    print("false positives and mean score without and with the penalty:", out)
    assert out[1.0][0] < out[0.0][0] and out[1.0][1] < out[0.0][1]
