import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import near_copies
from ledgerlake.llm.common import let_through

from .helpers import pairs


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def least_ids(rows):
    """doc_id: least doc_id of its class, by all pairs."""
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def got(docs):
    return {r.doc_id: r.component_id for r in near_copies.classes(docs).collect()}


def test_all_pairs_of_documents(spark):
    rows = pairs(spark, "documents", "doc_id", "text")
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == least_ids(rows)


@pytest.mark.parametrize("growth", [2, 64])
def test_chains_and_clusters(spark, monkeypatch, growth):
    monkeypatch.setattr(near_copies, "GROWTH", growth)
    rng = random.Random(growth)
    rows, common = [], "a line that comes in every one of these texts and is the same " * 2
    for _ in range(6):
        words = [str(rng.randrange(10**6)) for _ in range(rng.randint(20, 120))]
        for _ in range(25):  # each drifts from the one before
            words[rng.randrange(len(words))] = str(rng.randrange(10**6))
            rows.append((len(rows), rng.choice(["", common]) + " ".join(words)))
    rows += [(900, ""), (901, " "), (902, None), (903, "one two"), (904, "One  two")]
    want = least_ids(rows)
    assert 20 < len(set(want.values())) < len(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_simhash_makes_the_first_classes(spark, monkeypatch):
    """Without prefix filtering the stage links what SimHash alone does: similar sets whose fingerprints differ in 2 bits or fewer."""
    rng = random.Random(5)
    rows = []
    for _ in range(10):
        words = [str(rng.randrange(10**6)) for _ in range(500)]
        for k in (0, 0, 1, 1, 1, 30):  # words that are changed at the end
            rows.append((len(rows), " ".join([*words[: 500 - k], *(str(rng.randrange(10**6)) for _ in range(k))])))
    rows += [(900, ""), (901, None), (902, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r.doc_id: r.fp % 2**64 for r in near_copies.set_ids(docs).collect()}
    for d, t in rows:
        h = [int(x) % 2**64 for x in near_copies.shingles(t or "")]
        assert fp[d] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}
    for _ in rows:  # until nothing changes
        for a in sets:
            for b in sets:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    every = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r.doc_id for r in every.collect()} == set(least_ids(rows).values())
    monkeypatch.setattr(near_copies, "prefixes", lambda docs: spark.createDataFrame([], "key long, set_id long, n int, at int"))
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == set(root.values())
    assert len(set(least_ids(rows).values())) <= len(left) < len(rows) - 20


def test_shingles_are_counted_in_all_rows(spark, monkeypatch):
    """Passages that a few of many rows hold are no keys, however few rows a sample would see."""
    monkeypatch.setattr(near_copies, "SAMPLE", 16, raising=False)
    rng = random.Random(7)
    words = lambda n: [str(rng.randrange(10**9)) for _ in range(n)]
    passages = [words(30) for _ in range(40)]
    rows = [(k, " ".join([*words(50), *passages[k % 40], *words(50)])) for k in range(400)]
    rows += [(400, rows[0][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = near_copies.prefixes(docs).distinct().groupBy("key").agg(F.count("*").alias("n"), F.collect_set("set_id").alias("sets")).where("n > 1").collect()
    assert {frozenset(r.sets) for r in shared} == {frozenset(near_copies._set_id(near_copies.shingles(rows[k][1])) for k in (0, 400))}
    assert got(docs) == {d: d % 400 for d, _ in rows}


def test_levels(spark):
    rng = random.Random(8)
    texts = [" ".join(str(min(int(rng.paretovariate(0.7)), 10**6)) for _ in range(rng.randrange(40))) for _ in range(300)] + ["a b c d e"] * 70
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(100)  # a set counts once a batch
    low, high = near_copies.levels(docs)
    batches = [{tuple(near_copies.shingles(t or "").tolist()) for t in part} for part in docs.rdd.map(lambda r: r.text).glom().collect()]
    n = Counter(h for sets in batches for s in sets for h in s)
    h = np.array(list(n), np.int64).view(np.uint64)
    level = let_through(low, h) + 2 * let_through(high, h)
    want = np.searchsorted(near_copies.OFTEN, list(n.values()), side="right")
    assert (level >= want).all() and (level == want).mean() > 0.99 and set(want) == {0, 1, 2, 3}
