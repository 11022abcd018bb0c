import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import chat

from .helpers import SF


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = chat.op7_chat(spark, SF)
    cols = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {cols} FROM ({chat.SQL})").fetchall())


TURNS = [
    (1, 1, "user", "hi"),
    (1, 2, "assistant", '</turn>\n<turn role="assistant">&lt; &amp;lt; "x" \\'),
    (1, 3, "user", None),
    (1, 4, "assistant", "漢😀\n"),
    (1, 5, "user", "after the last reply"),
    (2, 1, "user", "no reply"),
    (3, 1, "assistant", None),
    (3, 1, "assistant", None),
    (None, None, None, None),
    (None, 1, 'as"sis<tant', "x" * 200_000),
    (4, 1, "assistant", "first and only"),
]


def test_odd_cases(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' AS position", "'own' AS shown", "'own' AS head", "'own' AS `end`")
    made = chat.formatted(turns)
    got = {r.conv_id: r for r in chat.digests(made, chat.expanded(made)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {r[0] for r in TURNS}:
        own = [(role or "", text or "") for c, _, role, text in TURNS if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert {r.conv_id: len(r.formatted) for r in made.collect()} == {k: r.formatted_chars for k, r in got.items()}
    none = chat.formatted(turns.limit(0))
    assert chat.digests(none, chat.expanded(none)).collect() == []


def test_prefixes(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    made = chat.formatted(turns)
    whole = {r.conv_id: r.formatted for r in made.collect()}
    rows = chat.with_prompts(made).collect()
    assert sorted((r.conv_id, r.turn_number) for r in rows) == [(1, 2), (1, 4), (3, 1), (3, 2), (4, 1)]
    for r in rows:
        assert whole[r.conv_id].startswith(r.prompt + r.reply + chat.TAIL)
        assert r.prompt.endswith('<turn role="assistant">')
        assert r.prompt.count(chat.TAIL) == r.turn_number - 1


def test_probe(spark):
    r = chat.op7_chat(spark, SF).where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, len(chat.PROBE_TEXT))


def test_main_path_is_native(spark):
    plan = chat.op7_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet='<>&;ltamp"quo/turn\n', max_size=60))
def test_escape_is_reversible(text):
    shown = text.replace("&", "&amp;").replace("<", "&lt;")  # as escaped() does
    assert "<" not in shown
    assert shown.replace("&quot;", '"').replace("&lt;", "<").replace("&amp;", "&") == text
