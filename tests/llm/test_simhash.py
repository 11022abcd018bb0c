import random

import numpy as np
import pytest

from ledgerlake.llm import simhash
from ledgerlake.llm.components import components

from .helpers import classes, fingerprint, no_docs, odd_docs, pairs


def test_query_equals_brute_force(spark):
    prints = [(d, fingerprint(t)) for d, t in pairs(spark, "documents", "doc_id", "text")]
    least = classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (f"{f:016x}", least[f]) for d, f in prints}


def test_odd_cases(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    least = classes([(d, fingerprint(t)) for d, t in rows])
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.classes(docs).collect())
    assert got == sorted((str(d), fingerprint(t), least[fingerprint(t)]) for d, t in rows)
    kept = simhash.one_of_each_class(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == ["1", "4", "4", "6", "9007199254740993", "None"]  # 2 and 3 have no word either; 5 goes with its copy
    assert simhash.classes(no_docs(spark)).collect() == []
    assert simhash.one_of_each_class(no_docs(spark)).collect() == []


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_dense_and_sparse_links(spark, max_bits):
    rng = random.Random(max_bits)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(4)}
    center = rng.getrandbits(64)
    values |= {center ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)} | {0, 2**64 - 1, 3, 1}
    signed = [v - 2**64 if v >> 63 else v for v in sorted(values)]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node % 2**64: r.root for r in components(simhash.links(nodes, max_bits), "test").collect()}
    want = classes([(v, v) for v in values], max_bits)
    groups = lambda of: sorted(sorted(v for v in values if of(v) == g) for g in {of(v) for v in values})
    assert groups(lambda v: got.get(v, ("alone", v))) == groups(lambda v: want[v])


def test_plan_meets_the_pigeonhole_sum():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 64, 500, np.uint64)
    for n in (10, 10**6, 10**11):
        parts = simhash.plan(sample, n, 2)
        assert all(0 <= t <= 2 for _, t in parts)
        for _ in range(300):
            flip = rng.choice(64, 2, replace=False)
            assert any(np.isin(flip, bits).sum() <= t for bits, t in parts)
    assert len(simhash.plan(np.zeros(0, np.uint64), 0, 2)) >= 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (101, 100)], "u long, v long")
    got = {r.node: r.root for r in components(edges, "chain").collect()}
    assert got == dict.fromkeys(range(61), 0) | {100: 100, 101: 100}
    assert components(edges.limit(0), "none").collect() == []
