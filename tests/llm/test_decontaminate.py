from ledgerlake.llm import decontaminate

from .helpers import LONG, contained, no_docs, odd_docs, pairs, table


def brute(docs, items):
    return sorted((d, i, *found) for d, t in docs for i, x in items if (found := contained(t, x)))


def test_query_equals_brute_force(spark):
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.op2_decontaminate(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(pairs(spark, "documents", "doc_id", "text"), pairs(spark, "benchmark", "item_id", "text"))
    assert got


ITEMS = [(1, None), (2, ""), (3, "one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine ten"), (None, "id less item of some words"), (5, "long text with"), (7, "Unicode 漢字 x"), (8, "ünïcödé 漢字 \x00 X"), (6, "again and again in both of these rows which is")]


def test_odd_cases(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'own' AS doc_id", "'own' AS n_shared")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: str(r)
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.matches(docs, items).collect()), key=key)
    want = sorted(((d, i, *found) for d, t in rows for i, x in ITEMS if (found := contained(t, x))), key=key)
    assert got == want
    assert len(got) >= 4  # the two equal rows, the other copy, the long one
    clean = decontaminate.clean_rows(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - sum(any(contained(t, x) for _, x in ITEMS) for _, t in rows)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.matches(no_docs(spark), items).collect() == []
    assert decontaminate.matches(odd_docs(spark), items.limit(0)).collect() == []
    assert decontaminate.clean_rows(odd_docs(spark), items.limit(0)).count() == odd_docs(spark).count()


def test_threshold_and_length():
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles
    found = lambda text: bool(decontaminate.Sketches([(1, item)]).find(text))
    words = item.split()
    assert found(LONG + item + LONG)
    assert found(" ".join(words[:20]))  # 16 of 20
    assert not found(" ".join(words[:19]))
    assert found(" ".join([*words[:12], "x", *words[12:]]))  # 16 of 20 around an insertion
    assert not found(" ".join([*words[:8], "x", *words[8:16], "y", *words[16:]]))


def test_short_items_are_whole_documents(spark):
    docs = spark.createDataFrame([(1, "Yes."), (2, "yes and no"), (3, "so they said yes to all of this again"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "yes"), (11, "YES"), (12, "yes and")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()) == [(1, 10), (1, 11)]
    assert sorted(r.doc_id for r in decontaminate.clean_rows(docs, items).collect()) == [2, 3, 4]


def test_one_broadcast_at_a_time(spark, monkeypatch):
    from pyspark import Broadcast

    live, most, made = set(), [], spark.sparkContext.broadcast

    def counted(value):
        sent = made(value)
        live.add(id(sent))
        most.append(len(live))
        destroy = sent.destroy
        monkeypatch.setattr(sent, "destroy", lambda: (live.discard(id(sent)), destroy()), raising=False)
        return sent

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    items = [x for (x,) in pairs(spark, "benchmark", "text")]
    got = {r.doc_id for r in decontaminate.clean_rows(docs, bench).collect()}
    assert got == {d for d, t in pairs(spark, "documents", "doc_id", "text") if not any(contained(t, x) for x in items)}
    assert len(most) >= 10
    assert max(most) == 1
    assert isinstance(made(1), Broadcast)


def test_many_items_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.matches(docs, bench).collect())
    assert got == brute(pairs(spark, "documents", "doc_id", "text"), pairs(spark, "benchmark", "item_id", "text"))
