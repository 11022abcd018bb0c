import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import mixing

from .helpers import no_docs, odd_docs, pairs


def ideal(blocks, weights, slots):
    """What each source has been served after each slot, slot by slot in fractions."""
    done, out = {s: Fraction(0) for s in blocks}, [dict.fromkeys(blocks, Fraction(0))]
    for _ in range(slots):
        time = Fraction(1)
        while time > 0:
            live = {s: Fraction(weights.get(s) or 0) for s in blocks if done[s] < blocks[s]}
            live = {s: w for s, w in live.items() if w} or dict.fromkeys(live, Fraction(1))
            total = sum(live.values())
            step = min([time, *((blocks[s] - done[s]) * total / w for s, w in live.items())])
            for s, w in live.items():
                done[s] += step * w / total
            time -= step
        out.append(dict(done))
    return out


def placed(blocks, weights):
    of = mixing.windows(blocks, weights)
    slots = mixing.earliest_deadline_first(of)
    assert sorted(t for s in slots.values() for t in s) == list(range(sum(blocks.values())))
    for s, taken in slots.items():
        assert len(taken) == blocks[s]
        assert taken == sorted(taken)
        assert all(a <= t < b for t, (a, b) in zip(taken, of[s], strict=True))
    return slots


@settings(deadline=None, max_examples=80)
@given(st.dictionaries(st.sampled_from([None, *"abcdef"]), st.integers(0, 25)), st.dictionaries(st.sampled_from([None, *"abcdx"]), st.floats(0, 5) | st.integers(1, 100)))
def test_less_than_one_block_off(blocks, weights):
    slots = placed({s: n for s, n in blocks.items() if n}, weights)
    for t, done in enumerate(ideal(blocks, weights, sum(blocks.values()))):
        for s in blocks:
            assert abs(sum(x < t for x in slots.get(s, [])) - done[s]) < 1


def test_weights_are_not_rounded():
    weights = {"a": 0.4236, "b": 0.57639, "rare": 0.00001}
    blocks = {"a": 42_360, "b": 57_639, "rare": 1}
    slots, total = placed(blocks, weights), sum(map(Fraction, weights.values()))
    end = min(blocks[s] * total / Fraction(w) for s, w in weights.items())  # up to here no source is exhausted
    for s, w in weights.items():
        for i, t in enumerate(slots[s]):
            assert t > end or (abs(i - t * Fraction(w) / total) < 1 and abs(i + 1 - (t + 1) * Fraction(w) / total) < 1)


def test_ten_thousand_sources():
    rng = random.Random(1)
    blocks = {f"s{k}": 1 + int(rng.paretovariate(1)) for k in range(10_000)}
    placed(blocks, {s: n**mixing.TEMPERATURE for s, n in blocks.items()})


def test_weights_that_mean_nothing():
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="weights"):
            mixing.windows({"a": 1}, {"a": bad})


def test_query_equals_brute_force(spark):
    rows = sorted(pairs(spark, "documents", "source", "doc_id"), key=lambda r: (r[0] or "", r[1]))
    got = {r.doc_id: r for r in mixing.op6_mixing(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    n = Counter(s for s, _ in rows)
    blocks = {s: -(-n[s] // mixing.BLOCK_ROWS) for s in sorted(n)}
    weights = {s: n[s] ** mixing.TEMPERATURE for s in blocks}
    served = ideal(blocks, weights, sum(blocks.values()))
    rank, order = Counter(), {}
    for t in range(sum(blocks.values())):  # of the released next blocks, the one that is due first
        due = []
        for k, s in enumerate(blocks):
            i = sum(x[0] == s for x in order)
            if i < blocks[s] and served[t + 1][s] > i:
                due.append((next(u for u, x in enumerate(served) if x[s] >= i + 1), k, s, i))
        order[min(due)[2:]] = t
    for s, d in rows:
        r, k = got[d], rank[s]
        rank[s] += 1
        slot = order[s, k // mixing.BLOCK_ROWS]
        assert (r.block, r.slot, r.position) == (k // mixing.BLOCK_ROWS, slot, slot * mixing.BLOCK_ROWS + k % mixing.BLOCK_ROWS)
        assert r.release_slot <= r.slot < r.deadline_slot


def test_odd_cases(spark):
    docs = odd_docs(spark)
    got = mixing.mixed(docs, {"hot": 1.0, "nowhere": 3.0}, block_rows=1).collect()
    assert sum(r.copies for r in got) == docs.count()
    assert len({r.position for r in got}) == len(got)
    assert sorted(r.slot for r in got if r.source == "hot") == [0, 1]  # the others have no weight until it is exhausted
    out = mixing.in_mixed_order(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(no_docs(spark)).collect() == []
    assert mixing.in_mixed_order(no_docs(spark)).collect() == []


def test_many_sources_and_large_blocks(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("source"))
    got = mixing.mixed(docs).collect()
    assert {r.slot for r in got} == set(range(1500))
    assert len({r.position for r in got}) == 3000
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    one = mixing.mixed(docs.withColumn("source", F.lit("x"))).collect()
    assert {r.slot for r in one} == set(range(10))
    assert [r.doc_id for r in sorted(one, key=lambda r: r.position)] == list(range(3000))
