import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import token_store
from ledgerlake.llm.common import new_path

from .helpers import no_docs, odd_docs, pairs


def library(path=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or token_store.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, token_store.END]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_equals_library(spark):
    got, ids_of, start = token_store.op3_token_store(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect(), library(), 0
    for r, (doc_id, text) in zip(got, sorted(pairs(spark, "documents", "doc_id", "text")), strict=True):
        ids = ids_of(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_odd_cases_and_round_trip(spark):
    docs, path, ids_of = odd_docs(spark), new_path(spark, "tokens"), library()
    token_store.write_store(docs, path)
    token_store.verify(spark, path)
    rows = sorted(token_store.digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    want = sorted((str(r.doc_id), crc(ids_of(r.text))) for r in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in rows) == want
    whole = [(str(r.doc_id), crc(np.frombuffer(r.data, "<u2"))) for r in token_store.read_documents(spark, path).collect()]
    assert sorted(whole) == want
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("id").distinct().count()
    assert sum(r.n for r in chunks.collect()) < sum(r.n_tokens for r in rows)  # equal passages are stored once


def test_tokenizer_of_another_kind(spark):
    import public_tokenizers

    other = public_tokenizers.path("word_bpe_49k.json")
    docs, path, ids_of = odd_docs(spark), new_path(spark, "tokens"), library(other)
    assert not token_store.encoder(other).by_pieces
    token_store.write_store(docs, path, tokenizer=other)
    want = sorted((str(r.doc_id), crc(ids_of(r.text))) for r in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in token_store.digests(spark, path).collect()) == want


def test_empty_table(spark):
    path = new_path(spark, "tokens")
    token_store.write_store(no_docs(spark), path)
    token_store.verify(spark, path)
    assert token_store.digests(spark, path).collect() == []


def test_damage_is_found(spark):
    path = new_path(spark, "tokens")
    token_store.write_store(odd_docs(spark), path)
    recipes = token_store.read_recipes(spark, path)
    names = recipes.columns
    bad = recipes.selectExpr(*("n_tokens + 1 AS n_tokens" if c == "n_tokens" else c for c in names)).collect()
    spark.createDataFrame(bad, recipes.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="damaged"):
        token_store.verify(spark, path)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=40), max_size=6))
def test_crcs_combine(parts):
    assert token_store.combined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=80))
def test_pieces_equal_library(text):
    text = text.encode("utf-8", "ignore").decode()
    e = token_store.encoder(token_store.tokenizer_path())
    assert e.encode([text])[0] == e.library([text])[0] + e.end


def test_chunks_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    same, head = rng.integers(0, 50_000, 20_000), rng.integers(0, 50_000, 777)
    ends = token_store.cuts(np.concatenate([head, same]))[0]
    a, b = set(token_store.cuts(same)[0]), {e - len(head) for e in ends}
    assert len(a & b) >= 0.9 * len(a)
    assert max(np.diff([0, *ends])) <= token_store.MOST_IDS
    assert token_store.cuts(np.zeros(10_000, np.int64))[0][-1] == 10_000
    assert token_store.cuts(np.zeros(0, np.int64), []) == []
    # Documents put together are cut as they are alone.
    assert token_store.cuts(np.concatenate([head, same, head[:3]]), [777, 20_000, 3]) == [token_store.cuts(x)[0] for x in (head, same, head[:3])]


def test_cuts_of_many_documents_are_those_of_each():
    rng = np.random.default_rng(7)
    lengths = [0, 1, 2, 6, 7, 8, 0, 9, 3, 30_000, 5, 700, 0]
    ids = rng.integers(0, 50_000, sum(lengths)).astype("<u2")
    stops = np.cumsum(lengths).tolist()

    def plain(x):
        ends, last = [], 0
        for i in range(len(x)):
            h = sum(int(x[i - j]) * int(token_store._ODD[j]) for j in range(min(token_store.WINDOW, i + 1))) % 2**64
            h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 % 2**64
            if (h >> 40) % token_store.MEAN_IDS == 0 or i + 1 - last == token_store.MOST_IDS or i + 1 == len(x):
                ends.append(last := i + 1)
        return ends

    want = [plain(ids[b - n : b]) for b, n in zip(stops, lengths, strict=True)]
    assert token_store.cuts(ids, lengths) == want
    assert [token_store.cuts(ids[b - n : b])[0] if n else [] for b, n in zip(stops, lengths, strict=True)] == want
