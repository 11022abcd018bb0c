import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import logs, snapshot
from ledgerlake.plans import tools


@pytest.fixture(scope="module")
def store(spark):
    entities = spark.createDataFrame([(1, "Acme Multi Cap", "Acme", "Equity"), (2, "Beta Liquid", "Beta", "Debt"), (3, "Gamma Gold", "Gamma", "Other")], "entity_id long, name string, family string, category string")
    snaps = [
        (1, 10, datetime.date(2026, 4, 4), "2026-04", 1, None, 1.0, 9.0, "Index", None, None),
        (1, 11, datetime.date(2026, 5, 4), "2026-05", 2, None, 6.65, 5.95, "Index", -14.58, '[{"name": "Ann", "role": "Equity", "experience_years": null}]'),
        (1, 12, datetime.date(2026, 5, 4), "2026-05", 1, datetime.datetime(2026, 5, 5), 99.0, 99.0, "old", None, None),
        (2, 20, datetime.date(2026, 5, 4), "2026-05", 1, None, None, 5.0, None, None, "no json"),
    ]
    schema = "entity_id long, snapshot_id long, as_of_date date, report_month string, revision int, superseded_at timestamp, return_1y double, return_1y_bm double, benchmark string, drawdown_pct double, fund_managers_json string"
    holdings = spark.createDataFrame([(1, "2026-05", f"h{i:02}", float(i), None) for i in range(12)] + [(1, "2026-04", "old", 99.0, None), (1, "2026-05", "no weight", None, "x")], "entity_id long, report_month string, security_name string, weight_pct double, sector string")
    sectors = spark.createDataFrame([(11, "b", 5.0), (11, "a", 5.0), (11, "c", 9.0), (10, "z", 1.0)], "snapshot_id long, sector string, weight_pct double")
    bars = spark.createDataFrame([("x", datetime.date(2026, 1, 1) + datetime.timedelta(i), 100.0 + i) for i in range(10)], "series string, day date, close double")
    topics = spark.createDataFrame([(0, "sip", "Regular plans", ["sip"], "pay monthly"), (1, "tax", "Taxes", None, None)], "position int, topic_id string, title string, aliases array<string>, content string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "position int, vector array<double>")
    return tools.Store(spark, entities, spark.createDataFrame(snaps, schema), holdings, sectors, bars, topics, lambda t: [0.1, 1.0] if "levy" in t else [-1.0, -1.0], vectors)


def call(store, tool, /, **arguments):
    return json.loads(tools.dispatch(store, tool, arguments))


def test_full_snapshot_has_six_sections(store):
    got = call(store, "get_full_snapshot", hint="acme multi")
    assert set(got) == {"matched", "entity", *snapshot.SECTIONS}
    assert got["entity"]["name"] == "Acme Multi Cap"
    assert got["snapshot"] == {"as_of_date": "2026-05-04", "report_month": "2026-05", "return_1y": 6.65}
    assert got["benchmark"] == {"name": "Index", "return_1y_bm": 5.95, "alpha": {"1y": 0.7}}
    assert got["drawdown"] == {"pct": -14.58}
    assert got["managers"] == [{"name": "Ann", "role": "Equity"}]
    assert [h["security_name"] for h in got["top_holdings"]] == [f"h{i:02}" for i in range(11, 1, -1)]
    assert got["sector_weights"] == [{"sector": "c", "weight_pct": 9.0}, {"sector": "a", "weight_pct": 5.0}, {"sector": "b", "weight_pct": 5.0}]


def test_full_snapshot_sections_and_misses(store):
    assert set(call(store, "get_full_snapshot", hint="acme", include=["benchmark", "nonsense"])) == {"matched", "entity", "benchmark"}
    assert set(call(store, "get_full_snapshot", hint="acme", include=[])) == {"matched", "entity", *snapshot.SECTIONS}
    assert call(store, "get_full_snapshot", hint="gamma gold")["message"] == "no snapshot"
    debt = call(store, "get_full_snapshot", hint="beta liquid")
    assert (debt["managers"], debt["top_holdings"], debt["sector_weights"], debt["drawdown"]) == ([], [], [], {})
    assert debt["benchmark"] == {"return_1y_bm": 5.0}
    assert call(store, "get_full_snapshot", hint="zzz")["matched"] is False
    assert call(store, "get_full_snapshot", hint=" ")["error"] == "bad_arguments"
    assert call(store, "get_full_snapshot", hint="acme", include="benchmark")["error"] == "bad_arguments"


def test_metrics_are_forty_seven():
    assert len(snapshot.METRICS) == len(set(snapshot.METRICS)) == 47


def test_lookup_and_comparison(store):
    assert [r["entity_id"] for r in call(store, "lookup_entity", name="multi cap acme")["rows"]] == [1]
    assert call(store, "lookup_entity", name="none such")["matched"] is False
    rows = call(store, "compare_entities", names=["beta", "nobody", "acme", "gamma"], metrics=["return_1y", "drop table"])["rows"]
    assert [r.get("error") for r in rows] == ["no_snapshot", "not found", None, "no_snapshot"] or rows[0] == {"requested": "beta", "name": "Beta Liquid"}
    assert rows[2] == {"requested": "acme", "name": "Acme Multi Cap", "return_1y": 6.65}
    assert call(store, "compare_entities", names="acme")["error"] == "bad_arguments"


def test_market_state(store):
    got = call(store, "get_market_state", series=["x", "y"])
    assert got["rows"][0]["close"] == 109.0
    assert got["errors"] == [{"series": "y", "error": "unknown series"}]


def test_topics(store):
    assert call(store, "get_topic", topic="what is SIP")["topic_id"] == "sip"
    assert (call(store, "get_topic", topic="a levy")["topic_id"], call(store, "get_topic", topic="a levy")["how"]) == ("tax", "vector")
    miss = call(store, "get_topic", topic="something else")
    assert miss["matched"] is False
    assert [t["topic_id"] for t in miss["available_topics"]] == ["sip", "tax"]


def test_dispatcher_never_raises(store):
    assert call(store, "no_tool")["error"] == "unknown_tool"
    assert json.loads(tools.dispatch(store, "query_db", [1]))["error"] == "bad_arguments"
    assert call(store, "query_db", sql="DROP TABLE x")["error"] == "read_only_refusal"
    assert call(store, "query_db", sql="SELECT DATE '2026-05-04' AS d")["rows"] == [{"d": "2026-05-04"}]
    broken = tools.Store(store.spark, None, None, None, None, None, None)
    assert call(broken, "lookup_entity", name="x")["error"] == "unexpected"


def test_contract():
    assert [t["function"]["name"] for t in tools.SCHEMAS] == ["query_db", "lookup_entity", "compare_entities", "get_full_snapshot", "get_market_state", "get_topic"]
    for t in tools.SCHEMAS:
        f = t["function"]
        assert t["type"] == "function"
        assert f["description"]
        assert set(f["parameters"]["required"]) <= set(f["parameters"]["properties"])


def test_loop(store):
    def client(messages):
        return {"calls": [("query_db", {"sql": "SELECT 1 AS a"})]} if len(messages) == 1 else {"text": messages[-1]["text"]}

    got = tools.ask(store, "one?", client)
    assert json.loads(got["answer"]) == {"rows": [{"a": 1}]}
    assert len(got["trace"]) == 1
    assert tools.ask(store, "?", lambda m: {"calls": [("none", {})]})["refusal_reason"] == "loop_exceeded"


def test_log_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "question string").repartition(3)
    assert logs.append(rows("c", "a", "b"), path, ["question"]) == (1, 3)
    assert logs.append(rows("e", "d"), path, ["question"]) == (4, 5)
    log = logs.read_log(spark, path, "question string")
    assert sorted((r.query_id, r.question) for r in log.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    events = lambda i: spark.createDataFrame([(i, "up")], "query_id long, feedback string")
    logs.feedback(log, events(2), f"file://{tmp_path}/fb")
    with pytest.raises(ValueError, match="no row 9"):
        logs.feedback(log, events(9), f"file://{tmp_path}/fb")
    assert spark.read.parquet(f"file://{tmp_path}/fb").count() == 1


def test_large_batches_of_a_log_are_numbered_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/large"
    rows = spark.range(200_000, numPartitions=8).selectExpr("(id * 7919) % 200000 AS at", "id % 3 AS kind")
    assert logs.append(rows.where("kind <> 0"), path, ["at"]) == (1, 133_333)
    got = [(r.query_id, r["at"]) for r in logs.read_log(spark, path, "at long, kind long").orderBy("at").collect()]
    assert [i for i, _ in got] == list(range(1, 133_334))
    assert [p.name for p in tmp_path.iterdir()] == ["large"]


def test_reports_and_question_sets(spark, tmp_path):
    out = spark.createDataFrame([("x", "ok", 1), ("y", "failed", 2), ("z", "ok", 3)], "entity string, status string, n_rows int")
    logs.write_report(out, "entity", "status", f"file://{tmp_path}/report")
    r = spark.read.json(f"file://{tmp_path}/report").first().asDict(recursive=True)
    assert r["totals"] == {"ok": 2, "failed": 1}
    assert [x["entity"] for x in r["outcomes"]["ok"]] == ["x", "z"]
    logs.write_transcript(out, f"file://{tmp_path}/transcript")
    assert spark.read.json(f"file://{tmp_path}/transcript").count() == 3
    q = spark.createDataFrame([("Q1", "a", "?", ["x"], False, None), ("Q1", "b", " ", [], False, None), ("Q2", "a", "?", None, True, None)], "id string, category string, question string, expected_answer_contains array<string>, must_refuse boolean, expected_refusal_reason string")
    faults = {(r.id, r.fault) for r in logs.question_faults(q, ["a"], {"a": 2, "c": 1}).collect()}
    assert faults == {("Q1", "no question"), ("Q1", "unknown category"), ("Q1", "an answer that expects nothing"), ("Q1", "an id that comes again"), ("Q2", "a refusal without a reason"), ("c", "a category with too few")}
    assert [r.id for r in logs.chosen(q, ["Q2", "Q9"]).collect()] == ["Q2"]
    assert logs.chosen(q, every=True).count() == 3
    s = logs.stable(spark.createDataFrame([(1, "x", '{"a": 1.5}')], "snapshot_id int, k string, js string"), {"js": "a double"})
    assert [(r.k, r.js.a) for r in s.collect()] == [("x", 1.5)]
    spark.range(1).createOrReplaceTempView("seen_view")
    assert ("seen_view", 1) in {(r.name, r.n_columns) for r in logs.catalog(spark).collect()}
    assert "seen_view" not in {r.name for r in logs.catalog(spark, ["seen"]).collect()}


def test_one_exchange_of_the_facts(spark):
    e = spark.createDataFrame([("a",)], "k string")
    f = spark.createDataFrame([("a", 1, 5.0, "p"), ("a", 2, 3.0, "q"), ("a", 3, 2.0, "p")], "k string, t int, v double, part string")
    df = snapshot.full_snapshot(e, f, "k", [F.desc("t")], "v", "part", 2)
    r = df.first()
    assert (r.header.t, [x.v for x in r.top], [(x.part, x.weight_pct) for x in r.mix]) == (3, [5.0, 3.0], [("p", 70.0), ("q", 30.0)])
