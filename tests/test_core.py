import datetime
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import clean, jsonx, text
from ledgerlake.operators import document, match, relational, snapshot
from ledgerlake.plans import guard
from ledgerlake.sources import tables


def one(spark, column, **cells):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cell", "value"),
    [("NA", None), ("n/a", None), ("-", None), ("--", None), ("", None), ("0E-9", 0.0), ("1,234.50 Cr", 1234.5), ("12.5%", 12.5), ("-0.01", -0.01), ("nan", None), ("inf", None), ("abc", None), (None, None)],
)
def test_to_double(spark, cell, value):
    assert one(spark, clean.to_double(F.col("c")), c=cell) == value


def test_to_int_cuts_toward_zero(spark):
    assert one(spark, clean.to_int(F.col("c")), c="-2.9") == -2
    assert one(spark, clean.to_int(F.col("c")), c="1e99") is None


@pytest.mark.parametrize("cell", ["4 May 2026", "04-May-26", "2026-05-04", "4/May/2026", "04 May 2026", "4  May 2026", " 4 -May- 26 "])
def test_to_date(spark, cell):
    assert one(spark, clean.to_date(F.col("c")), c=cell) == datetime.date(2026, 5, 4)


def test_years_of_two_digits(spark):
    assert one(spark, clean.to_date(F.col("c")), c="4 May 95") == datetime.date(1995, 5, 4)
    assert one(spark, clean.to_date(F.col("c")), c="29 Feb 68") == datetime.date(2068, 2, 29)


def test_labels(spark):
    assert one(spark, clean.month_key(F.col("c")), c="March 2024") == "2024-03"
    assert one(spark, clean.month_key(F.col("c")), c="MTD") is None
    assert one(spark, clean.period_label(F.col("c")), c="fy 24") == "FY 24"
    assert one(spark, clean.age(F.col("c")), c="2 Years 9 Months") == "2Y 9M"
    assert one(spark, clean.age(F.col("c")), c="new") == "new"
    for spelled in ("As On: 4 May 2026 y", "as on 04-May-26", "AS ON - 4/May/2026,", "As  On:4   May 2026", "As on 04 May 26 12:00"):
        assert one(spark, clean.as_of(F.col("c")), c=f"x {spelled}") == datetime.date(2026, 5, 4)
    assert one(spark, clean.as_of(F.col("c")), c="as on nothing") is None


def test_text(spark):
    assert one(spark, text.tokens(F.col("c")), c="The Multi-Cap fund, multi a") == ["multi", "cap", "multi"]
    assert one(spark, text.slug(F.col("c")), c="--A  b/C!") == "a-b-c"
    assert one(spark, text.unicode_norm(F.col("c")), c="A –B") == "a -b"
    assert one(spark, text.truncated(F.col("c"), 3), c="abcd") == "abc...[truncated]"
    assert one(spark, text.prefix_before(F.col("c"), ["Cap", "Multi"]), c="Acme Multi Cap") == "Acme Multi"
    assert one(spark, text.prefix_before(F.col("c"), ["Acme"]), c="Acme Cap") is None
    assert one(spark, text.contains_either_way(F.col("a"), F.col("b")), a=" Beta ", b="what is beta?") is True
    assert one(spark, text.contains_either_way(F.col("a"), F.col("b")), a="", b="x") is False
    assert one(spark, text.first_number(F.col("c")), c="no -1.5 yes 2") == -1.5
    name, args = text.marked_call(F.col("c"))
    assert one(spark, name, c='<function=f {"a":\n1}</function>') == "f"
    assert one(spark, args, c="none") is None


def test_null_trim_keeps_falsy(spark):
    m = F.create_map(F.lit("a"), F.lit(0), F.lit("b"), F.lit(None).cast("int"))
    assert one(spark, jsonx.without_nulls(m), c="") == {"a": 0}
    assert one(spark, jsonx.json_or_raw(F.col("c")), c="{bad") == '{"_raw":"{bad"}'


def test_alpha_and_change(spark):
    assert one(spark, F.round(F.lit(6.65) - F.lit(5.95), 2), c="") == 0.70
    assert one(spark, clean.percent_change(F.lit(5.0), F.lit(0.0)), c="") is None


@pytest.mark.parametrize("sql", ["SELECT 1 AS created_at", "WITH t AS (SELECT 1 AS a) SELECT a FROM t", "SELECT 'update' AS x", "VALUES (1)", "SELECT 1 -- end"])
def test_guard_lets_queries_through(spark, sql):
    assert guard.query(spark, sql).count() == 1


@pytest.mark.parametrize(
    "sql",
    ["DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a=b", "RESET", "SHOW TABLES", "CLEAR CACHE", "USE x", "CALL p()", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT 1) OR EXISTS (SELECT 2", "SELECT reflect('java.lang.System', 'exit', 1)", "", "SELECT 1; SELECT 2", "TRUNCATE TABLE t", "CACHE TABLE t"]
    + [
        "SELECT `reflect`('java.util.UUID', 'randomUUID')",
        "SELECT reflect/**/('java.lang.System', 'getProperty', 'user.name')",
        "SELECT ReFlect -- x\n('java.lang.System', 'getProperty', 'user.name')",
        "SELECT system.builtin.java_method('java.util.UUID', 'randomUUID')",
        "SELECT try_reflect('java.util.UUID', 'randomUUID')",
        "SELECT 1 FROM range(1) WHERE EXISTS (SELECT 1 WHERE reflect('java.util.UUID', 'randomUUID') = 'x')",
        "WITH t AS (SELECT java_method('java.util.UUID', 'randomUUID') AS a) SELECT * FROM t",
        "SELECT IDENTIFIER('reflect')('java.util.UUID', 'randomUUID')",
        "SELECT * FROM IDENTIFIER('parquet.`/tmp`')",
        "SELECT * FROM parquet.`/tmp`",
        "SELECT TRANSFORM(a) USING 'cat' FROM (SELECT 1 AS a)",
        "SELECT no_such_function(1)",
    ],
)
def test_guard_refuses(spark, sql):
    with pytest.raises(guard.Refused):
        guard.check(spark, sql)


def test_guard_looks_into_windows_and_keeps_the_session(spark):
    before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    with pytest.raises(guard.Refused):
        guard.query(spark, "SELECT sum(id) OVER w AS s FROM range(2) WINDOW w AS (ORDER BY reflect('java.util.UUID', 'randomUUID'))")
    assert spark.conf.get("spark.sql.runSQLOnFiles", "true") == before
    assert guard.query(spark, "SELECT upper('a') AS a, count(*) OVER () AS n, CASE WHEN 1 < 2 THEN 'reflect(x)' END AS `reflect` FROM range(2) JOIN (SELECT explode(array(1)) AS z)").count() == 2


def test_guard_strict_and_envelopes(spark):
    with pytest.raises(guard.Refused):
        guard.check(spark, "SELECT 'update'", strict=True)
    guard.check(spark, "SELECT 1 AS created_at", strict=True)
    assert guard.answer(spark, 5)["error"] == "bad_arguments"
    assert guard.answer(spark, "DROP TABLE x")["error"] == "read_only_refusal"
    assert guard.answer(spark, "SELECT nope FROM nowhere")["error"] == "sql_error"
    assert len(guard.answer(spark, "SELECT * FROM range(300)")["rows"]) == 100
    with pytest.raises(Exception, match="(?i)not.*(support|found)|cannot"):
        guard.query(spark, "SELECT * FROM parquet.`/tmp`").collect()


def test_revisions_skip_equal_content(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x")], "k string, t int, c string")
    got = snapshot.revisions(df, ["k"], [F.col("t")], F.col("c"), "t").orderBy("t").collect()
    assert [(r.t, r.revision, r.superseded_at) for r in got] == [(1, 1, 3), (3, 2, 4), (4, 3, None)]


def test_insert_ignore_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    added = snapshot.inserted(target, new, ["k"])
    assert added.count() == 1
    assert snapshot.inserted(target.union(added), new, ["k"]).count() == 0


def test_take_while_and_anchors(spark):
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate("x S 1 2 E 3".split())], "k string, i int, w string")
    assert [r.w for r in relational.take_while(df, ["k"], [F.col("i")], F.col("w") == "E").orderBy("i").collect()] == ["x", "S", "1", "2"]
    between = lambda end: [r.w for r in relational.between_anchors(df, ["k"], F.col("i"), F.col("w") == "S", F.col("w") == end).orderBy("i").collect()]
    assert between("E") == ["1", "2"]
    assert between("none") == ["1", "2", "E", "3"]
    assert between("x") == ["1", "2", "E", "3"]


def test_clusters_compare_with_first_member(spark):
    words = spark.createDataFrame([("d", 1, i, 0.0, y, f"w{i}") for i, y in enumerate([0.0, 3.0, 6.0])], "doc_id string, page int, ord int, x0 double, top double, text string")
    assert [r.tokens for r in document.lines(words, (0.0, 1.0)).orderBy("y").collect()] == [["w0", "w1"], ["w2"]]


def test_as_of(spark):
    a = spark.createDataFrame([("k", 1), ("k", 5), ("z", 5)], "k string, t int")
    b = spark.createDataFrame([("k", 2, "v"), ("k", 5, "w")], "k string, t int, x string")
    assert sorted((r.k, r.t, r.x) for r in relational.as_of(a, b, "k", "t", "t", ["x"]).collect()) == [("k", 1, None), ("k", 5, "w"), ("z", 5, None)]


def test_nearest_takes_first_of_ties(spark):
    assert one(spark, relational.nearest_value(F.col("c"), [1, 3]), c=2.0) == 1.0


def test_fuzzy_ignores_null_surface_and_word_order(spark):
    df = spark.createDataFrame([(1, "multi cap acme"), (2, None), (3, "other")], "k int, s string")
    assert [r.k for r in match.fuzzy(df, F.col("s"), "acme MULTI", [F.col("k")]).collect()] == [1]


def test_equal_questions_each_have_a_topic(spark):
    df = spark.createDataFrame([(1, "what is beta"), (1, "what is beta"), (2, None), (3, "alp")], "k int, q string")
    got = match.first_topic(df, "q", [(0, "gamma"), (1, "beta"), (2, "what"), (3, "alpha")], "topic").collect()
    assert sorted((r.k, r.topic) for r in got if r.topic is not None) == [(1, 1), (1, 1), (3, 3)]
    assert len(got) == 4


def test_topic_search_by_text_then_vector(spark):
    q = spark.createDataFrame([(1, "beta?"), (2, "explain"), (3, "far"), (4, "none")], "k int, q string")
    v = spark.createDataFrame([(2, [1.0, 0.1]), (3, [-1.0, -1.0])], "k int, vector array<double>")
    t = spark.createDataFrame([(0, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "position int, vector array<double>")
    got = {r.k: (r.topic, r.how) for r in match.topic_search(q, "k", "q", [(1, "beta")], v, t).collect()}
    assert got == {1: (1, "alias"), 2: (0, "vector"), 3: (None, "not found"), 4: (None, "not found")}


def test_differences_are_of_six_digits(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, "x"), (2, 1234567.0, "y"), (3, None, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 0.3, "x"), (2, 1234567.4, "y"), (3, None, "z")], "k int, v double, s string")
    assert relational.symmetric_difference(a, b).collect() == []
    c = spark.createDataFrame([(1, 0.30001, "x")], "k int, v double, s string")
    assert sorted(r.side for r in relational.symmetric_difference(a.where("k = 1"), c).collect()) == ["left", "right"]


def test_spans_hold_from_start_to_end(spark):
    facts = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "k string, t int")
    spans = spark.createDataFrame([("a", 2, 6, "one"), ("a", 7, 9, "two"), ("a", 9, None, "open")], "k string, since int, until int, name string")
    assert sorted((r.k, r.t, r.name) for r in relational.valid_at(facts, spans, "k", "t", "since", "until").collect()) == [("a", 5, "one"), ("a", 9, "open")]


def test_publish_is_all_or_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    tables.publish({"a": spark.range(3), "b": spark.range(2)}, folder, "1")
    spark.range(7).write.parquet(f"{folder}/batches/2/a")  # a batch that broke off before its manifest
    assert tables.published(spark, folder, "a").count() == 3


def test_entry_and_oracles_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    root = Path(__file__).parent.parent
    shutil.copytree(root / "ledgerlake", tmp_path / "ledgerlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for pipeline in (False, True):  # with and without the pipeline's file
        if pipeline:
            (tmp_path / "corpus_pipeline.py").write_text("from ledgerlake.llm import toxicity\n")
        code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op1') for k in q) and len(q) > 100"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_operators_that_miss_a_library_are_left_out(tmp_path):
    root = Path(__file__).parent.parent
    shutil.copytree(root / "ledgerlake", tmp_path / "ledgerlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "ledgerlake" / "llm").mkdir()
    (tmp_path / "ledgerlake" / "llm" / "__init__.py").touch()
    (tmp_path / "ledgerlake" / "llm" / "queries.py").write_text("import no_such_library\n")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import warnings; warnings.simplefilter('error', SyntaxWarning); import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert "no_such_library" in done.stderr


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_stream_matches_batch(spark, tmp_path):
    from ledgerlake.streaming import revisions

    events = tables.read(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = revisions.daily(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, revisions.daily(events).collect()))


def test_sessions_of_a_stream(spark, tmp_path):
    from ledgerlake.streaming import revisions

    events = tables.read(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = revisions.sessions(stream).writeStream.outputMode("append").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    whole = {tuple(r) for r in revisions.sessions(events).collect()}
    got = [tuple(r) for r in spark.table("sessions").collect()]  # those that the watermark has closed
    assert set(got) <= whole
    assert len(got) == len(set(got))


def test_appended_batches_fold_to_an_upsert(spark, tmp_path):
    from ledgerlake.streaming import revisions

    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, rows in enumerate([[("a", 1), ("b", 2)], [("a", 3)], [("a", 5), ("c", 4)]]):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(str(source))
        q = revisions.appended(spark.readStream.schema("k string, v int").parquet(str(source)), out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(out).select("batch").distinct().count() == i + 1
    assert sorted((r.k, r.v, r.revision) for r in revisions.current(spark, out, ["k"], ["v"]).collect()) == [("a", 5, 3), ("b", 2, 1), ("c", 4, 1)]
    assert [(r.v, r.superseded_in) for r in revisions.revised(spark, out, ["k"], ["v"]).where("k = 'a'").orderBy("revision").collect()] == [(1, 1), (3, 2), (5, None)]
