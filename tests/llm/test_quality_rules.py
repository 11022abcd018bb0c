import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import quality_rules as q

from .helpers import counts, no_docs, odd_docs, pairs


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["a", "b", "a b c d e f g h ", " ", "\n", "\n\n", "#", "é", " ", "\x0b", "x y\n", "a b\n", "\x1f"]), max_size=60))
def test_counts(parts):
    text = "".join(parts)
    assert q.counts_of(text)[:5] == counts(text)


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in q.op10_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    docs = dict(pairs(spark, "documents", "doc_id", "text"))
    assert set(got) == set(docs)
    for d, r in got.items():
        n = counts(docs[d])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def test_odd_cases(spark):
    got = q.judge(odd_docs(spark), []).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(r.doc_id), counts(r.text)[0]) for r in odd_docs(spark).collect())
    assert all(r.kept == (not r.base_failed) for r in got)
    assert q.judge(no_docs(spark), []).collect() == []
    labels = spark.createDataFrame([(4, None, 0), (None, 1, 0), (6, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert q.learn_from(odd_docs(spark), labels) == []  # one class only


def test_rules_are_found_and_emitted(spark):
    rng = np.random.default_rng(5)
    x = {k: rng.random(3000) for k in q.FEATURES}
    bad = (x["symbols_per_word"] > 0.8) | ((x["n_words"] < 0.3) & (x["upper_share"] > 0.6))
    rules = q.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= r.mask(x)
    assert (hit == bad).mean() > 0.97
    rows = [(int(a), int(b), int(c), 10, 0, 1, int(d), 5, 1, 0, 1) for a, b, c, d in rng.integers(1, 100, (200, 4))]
    stats = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in q.COUNTS))
    got = stats.select(*(c.alias(k) for k, c in q.features().items()), q.as_column(rules).alias("good")).toPandas()
    want = np.zeros(200, bool)
    for r in rules:
        want |= r.mask({k: got[k].to_numpy() for k in q.FEATURES})
    assert (got["good"].to_numpy() == ~want).all()
    assert q.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = q.judge(docs, q.learn_from(docs, labels)).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.95 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = []
    for k in range(3):
        rules = q.learn_from(docs, labels.where(third != k))
        rows += q.judge(docs, rules).join(labels.where(third == k), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]  # base rules are given, not learned
    assert len(rows) == labels.count()
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_clashing_rows_teach_the_same_rules(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = docs.select("doc_id", "text").union(docs.select("doc_id", F.lit("another text")))
    assert q.learn_from(both.repartition(3), labels) == q.learn_from(both.repartition(7, "text"), labels)
