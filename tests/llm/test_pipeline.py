import pytest

import corpus_pipeline
from ledgerlake.llm import common, mixing, near_copies, token_store, toxicity
from ledgerlake.llm.common import table, written

from .helpers import SF, contained, no_docs, odd_docs, pairs
from .test_near_copies import least_ids


def test_run_equals_brute_force(spark):
    docs = {d: (s, t) for d, s, t in pairs(spark, "documents", "doc_id", "source", "text")}
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    left = {d: x for d, x in docs.items() if model is None or model.score(x[1] or "") < 0.7}
    least = least_ids([(d, t) for d, (_, t) in left.items()])
    left = {d: x for d, x in left.items() if least[d] == d}
    items = [x for (x,) in pairs(spark, "benchmark", "text")]
    left = {d: x for d, x in left.items() if not any(contained(x[1], i) for i in items)}
    rows = spark.createDataFrame([(d, s) for d, (s, _) in left.items()], "doc_id long, source string")
    order = sorted(mixing.mixed(rows).collect(), key=lambda r: r.position)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.tokenizer_path())
    want, start = [], 0
    for r in order:
        n = len(t.encode(left[r.doc_id][1] or "", add_special_tokens=False).ids) + 1
        want.append((r.doc_id, start, n))
        start += n
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == want
    assert 0.3 * len(docs) < len(got) < len(docs)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_documents(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (odd_docs(spark), no_docs(spark)):
        docs = written(docs, "docs")
        out = written(stage(spark, docs, SF), name)
        if k < 4:
            assert out.columns == docs.columns
        if name in ("mixing", "token_ids"):
            assert out.count() == docs.count()
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_release_the_executors_heaps(spark, monkeypatch):
    docs, collected = written(no_docs(spark), "docs"), []
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    monkeypatch.setattr(common, "HEAPS_S", 0.0)
    for module in (common, near_copies):  # the driver's own collections do not count here
        monkeypatch.setattr(module, "release_shuffles", lambda spark: None)
    for _, stage in corpus_pipeline.STAGES:
        before = [b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
        stage(spark, docs, SF)
        collected.append(sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()) - sum(before))
    assert min(collected) >= 1
