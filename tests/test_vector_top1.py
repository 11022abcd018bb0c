import numpy as np

from ledgerlake.plans.operator_queries import vector_top1


def test_neighbours_are_sought_over_all_labels(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    labels = {r.vec_id: r.label for r in rows}
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    got = {r.vec_id: r for r in vector_top1(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(ids)
    at = {v: i for i, v in enumerate(ids)}
    for i, v in enumerate(ids):
        assert abs(scores[i, at[got[v].neighbour]] - scores[i].max()) < 2e-6
        assert abs(got[v].score - scores[i].max()) < 1e-4
        assert got[v].matched == int(round(scores[i].max(), 6) >= 0.5)
    assert any(labels[v] != labels[got[v].neighbour] for v in ids)
