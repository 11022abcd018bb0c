import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import bwt_dedup

from .helpers import CLASHING, no_docs, odd_docs, pairs, repeated_bytes


def test_query_equals_brute_force(spark):
    want = repeated_bytes(sorted(pairs(spark, "documents", "doc_id", "text")))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.op8_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 0


def passages():
    """Edited copies, runs of one byte, passages in many documents, borders at every offset, texts of about 100 bytes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij éß漢", k=rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, other = text(40), text(60)
    out = []
    for i in range(60):
        p, q = rng.randint(0, 30), rng.randint(0, 90)
        out += [text(p) + common[q % 20 :] + text(5), common[: 80 + i] + "|" + other[i:], "a" * (95 + i % 12), (other[:110] + "-") * (i % 4)]
    out += [other, other, other[:99], other[:100], "ab" * 300, "", "x" * 5000]
    return list(enumerate(out))


def test_passages(spark, monkeypatch):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    run = lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.deduplicated(docs).collect()}
    want = repeated_bytes(rows)
    assert run() == want
    monkeypatch.setattr(bwt_dedup, "CHUNK_SPANS", 10)  # anchors cross chunks
    assert run() == want
    monkeypatch.setattr(bwt_dedup, "HOT_SPANS", 3)
    whole = bwt_dedup.slices
    monkeypatch.setattr(bwt_dedup, "slices", lambda texts: whole(texts, 200))  # texts in slices
    assert run() == want
    monkeypatch.undo()
    monkeypatch.setattr(bwt_dedup, "resolve", lambda spans, place: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.array(list(map(len, spans)))))
    assert run() != want  # the merged transforms are what finds the rest


def test_odd_cases(spark):
    docs = odd_docs(spark)
    got = bwt_dedup.deduplicated(docs).collect()
    assert len(got) == docs.count()
    order = [tuple(r) for r in docs.select("doc_id", "text").distinct().withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy("doc_id", "th").select("doc_id", "text").collect()]
    want = repeated_bytes([((d, t), t) for d, t in order])
    texts = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert texts == sorted((str(r.doc_id), *want[r.doc_id, r.text]) for r in docs.select("doc_id", "text").collect())
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got)
    assert bwt_dedup.deduplicated(no_docs(spark)).collect() == []
    assert not set(CLASHING) - set(docs.columns)


def test_interleaving_equals_sorting():
    rng = random.Random(2)
    for symbols, length in (([1, 2], 9), ([1, 2, 300, 70_000], 4), ([5], 6)):
        strings = [np.array(rng.choices(symbols, k=rng.randint(1, 40)), np.int64) for _ in range(14)]
        made = [bwt_dedup.transform(strings[i : i + 5], length) for i in (0, 5, 10)]
        shard, prefix = bwt_dedup.interleaved([t for t, _ in made], length)
        assert np.bincount(shard).tolist() == [len(t) for t, _ in made]
        suffixes = sorted((tuple(s[o:].tolist())[:length] + (0,) * (length - len(s) + o > 0), i, o) for i, s in enumerate(strings) for o in range(len(s) + 1))
        rows = [[] for _ in made]
        for k, (_, places) in enumerate(made):
            part = strings[5 * k : 5 * k + 5]
            begin = np.cumsum([0, *(len(s) + 1 for s in part)])
            for p in places.tolist():
                i = int(np.searchsorted(begin, p, "right")) - 1
                rows[k].append(tuple(part[i][p - begin[i] :].tolist())[:length])
        order = [rows[k].pop(0) for k in shard.tolist()]
        assert [x for x in order if len(x) == length] == sorted(x for x in order if len(x) == length)
        assert len(order) == len(suffixes)
        for h, x, y in zip(prefix[1:].tolist(), order, order[1:], strict=False):
            common = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
            assert h == common
        seen, want = set(), []
        for i, s in enumerate(strings):
            for o in range(len(s) - length + 1):
                w = tuple(s[o : o + length].tolist())
                want += [(i, o)] * (w in seen)
                seen.add(w)
        assert sorted(zip(*(c.tolist() for c in bwt_dedup.repeats(strings, length)), strict=True)) == want


def test_windows_of_an_anchor_by_their_cores():
    texts = [t for _, t in passages()]
    for _, _, starts, data in bwt_dedup.slices(texts):
        _, key, a, size, place = bwt_dedup.runs(data, starts)
        for k in np.unique(key):
            at = np.flatnonzero(key == k)
            spans, seen, want = [data[a[i] : a[i] + size[i]] for i in at], set(), []
            for j, s in enumerate(spans):
                for o in range(len(s) - bwt_dedup.LENGTH + 1):
                    w = s[o : o + bwt_dedup.LENGTH]
                    want += [(j, o)] * (w in seen)
                    seen.add(w)
            span, offset, _ = bwt_dedup.resolve(spans, place[at])
            assert list(zip(span.tolist(), offset.tolist(), strict=True)) == want


def test_long_text(spark):
    same = "".join(random.Random(5).choices("abcdefg ", k=3_000))
    long = same + "".join(random.Random(6).choices("abcdefg ", k=2_500_000)) + same
    docs = spark.createDataFrame([(1, long), (2, "z" * 50 + long[-200_000:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in bwt_dedup.deduplicated(docs).collect()}
    assert got == {1: (len(long), 3_000, 1), 2: (200_050, 200_000, 1)}
