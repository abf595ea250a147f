"""op6 against all pairs: the registered query on near vectors made here, and rows that share a vec_id."""

import numpy as np

from eventloom.llm import embeddings, queries


def truth(rows, least=0.93):
    """(links, smallest vec_id reached) of each row, by all pairs."""
    x = np.array([r[1] for r in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= least) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    reach = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(reach, np.where(near, reach[None], np.iinfo(np.int64).max).min(axis=1))
        if (new == reach).all():
            return near.sum(axis=1), reach
        reach = new


def near_vectors(groups=150, d=64):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=d)
        for _ in range(1 + g % 6):
            v = centre + rng.choice([0.0, 0.1, 0.25]) * rng.normal(size=d)
            rows.append((len(rows), [float(a) for a in v], g % 4))
    return rows


def test_query_recall_on_all_pairs(spark, tmp_path):
    rows = near_vectors()
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in queries.op6_embeddings(spark, f"file://{tmp_path}").collect()}
    links, _ = truth(rows)
    assert links.sum() > 500 and all(got[i] <= n for (i, *_), n in zip(rows, links, strict=True))
    assert sum(got.values()) >= 0.9 * links.sum()


def test_rows_that_share_a_vec_id_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=32)
    near = lambda: [float(v) for v in base + 0.05 * rng.normal(size=32)]
    other = [float(v) for v in rng.normal(size=32)]
    rows = [(5, near(), 0), (5, near(), 0), (9, near(), 0), (5, other, 0), (3, other, 0), (3, other, 0)]
    links, reach = truth(rows)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((r[0], int(n), int(c)) for r, n, c in zip(rows, links, reach, strict=True))
    assert sorted(n for r, n in zip(rows, links, strict=True) if r[0] == 5) == [2, 2, 2]
