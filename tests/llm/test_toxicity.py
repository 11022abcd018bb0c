import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import toxicity

from .helpers import no_docs, odd_docs, odd_rows, remainder, table


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(toxic) >= 100
    assert sum(r.predicted for r in toxic) >= 0.65 * len(toxic)  # 0.73 with the 305 toxic rows there are to learn from
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_weights_are_sparse(model):
    assert 0 < len(model.at) < 20_000


def test_held_out_labels_teach_nothing(spark, model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.remainder() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, other)
    assert again.at.tolist() == model.at.tolist()
    assert again.values.tolist() == model.values.tolist()


def test_odd_cases(spark, model):
    rows = toxicity.scored(odd_docs(spark), model).collect()
    assert len(rows) == len(odd_rows())
    assert {r.doc_id for r in rows} == {r[0] for r in odd_rows()}
    for r in rows:
        assert r.held_out == (None if r.doc_id is None else remainder(r.doc_id) == 1)
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1  # null, empty, no word: the intercept
    assert toxicity.scored(no_docs(spark), model).collect() == []


def test_no_labels_of_both_classes(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd_docs(spark), labels) is None
    assert {r.score for r in toxicity.scored(odd_docs(spark), None).collect()} == {toxicity.BASE}


def test_clean_rows_keep_all_columns(spark, model):
    docs = odd_docs(spark)
    out = toxicity.clean_rows(docs, model)
    assert out.columns == docs.columns
    kept = [r for r in toxicity.scored(docs, model).collect() if r.score < 0.7]
    assert out.count() == len(kept)


def test_same_model_each_time():
    rows, y = [toxicity.distinct_features(t) for t in ["a b c", "bad bad words here", "fine", "bad words"] * 20], [0, 1, 0, 1] * 20
    a, b = toxicity.train(rows, y), toxicity.train(rows, y)
    assert a.values.tolist() == b.values.tolist()
    assert a.score("bad words") > 0.7 > a.score("fine")


def test_weights_equal_a_plain_version():
    """FTRL-proximal as published, coordinate by coordinate."""
    rows = [toxicity.distinct_features(t).tolist() for t in ["a b c", "bad bad words here", "fine words", "bad words", "a bad c"] * 30]
    y = [0, 1, 0, 1, 0] * 30
    z, n = {}, {}

    def weight(i, l1):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    penalty = lambda i: 0.0 if i == "one" else toxicity.L1
    for _ in range(toxicity.EPOCHS):
        for x, label in zip(rows, y, strict=True):
            w = {i: weight(i, penalty(i)) for i in [*x, "one"]}
            g = (1 / (1 + math.exp(-sum(w.values()))) - label) * (toxicity.TOXIC_WEIGHT if label else 1)
            for i in w:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
    want = {i: w for i in z if i != "one" and (w := weight(i, penalty(i)))}
    model = toxicity.train([np.array(x, np.int32) for x in rows], y)
    assert want
    assert dict(zip(model.at.tolist(), model.values.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
    assert model.intercept == pytest.approx(weight("one", 0.0))


def test_one_text_of_a_doc_id_teaches(spark):
    rows = [(k, "bad words" if k % 2 else "fine day") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    clashing = [*rows, *((k, "something else") for k in range(300))]
    a, b = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(k), labels) for x, k in ((clashing, 3), (clashing[::-1], 5)))
    assert (a.at.tolist(), a.values.tolist(), a.intercept) == (b.at.tolist(), b.values.tolist(), b.intercept)


def test_query_covers_every_row(spark):
    got = toxicity.op1_toxicity(spark, "/root/testdata/sf0.001")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == table(spark, "documents").count()
