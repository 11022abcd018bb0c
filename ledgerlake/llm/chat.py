r"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A conversation is written once, as `formatted`: each turn is
`<turn role="ROLE">TEXT</turn>` and a line end. In texts and roles & becomes &amp;
and < becomes &lt; (in roles also " becomes &quot;), so no text can hold a mark and
unescaping gives back what was there. Every assistant turn is an example of its own:
its context is all of `formatted` before it, and only its reply is trainable. `expanded`
explodes them into a row each: the reply as a text, and the context as a prefix of the
conversation (context_end, target_start and target_end in code points), so the output
grows with the conversation and not with its square; `with_prompts` writes prefixes out.
What is read back comes from both tables.

Defined cases: null texts and roles count as empty, a role other than `assistant`
trains nothing; turns are in order of turn (null first), then role, then text, so ties
and repeated rows keep one order and each is a turn; a null conv_id is a conversation;
a conversation without assistant turns has no example, loss_chars 0 and the digest of
the empty text; turns after the last reply stay in `formatted`; an empty table gives
an empty result; further columns are ignored. One conversation is put together in one
task, as its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.common import table, written

HEAD, MIDDLE, TAIL = '<turn role="', '">', "</turn>\n"
TRAINED = "assistant"
#: Asks whether control strings in texts survive.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and examples (an array of spans) of each conversation. turns: conv_id, turn, role, text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    role = F.replace(escaped(F.col("role")), F.lit('"'), F.lit("&quot;"))
    head = F.concat(F.lit(HEAD), role, F.lit(MIDDLE))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", head).withColumn("shown", F.concat("head", escaped(F.col("text")), F.lit(TAIL)))
    rows = rows.withColumn("position", F.row_number().over(order)).withColumn("end", F.sum(F.length("shown").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    start = F.col("end") - F.length("shown")
    span = F.struct(F.col("position").alias("turn_number"), start.alias("context_end"), (start + F.length("head")).alias("target_start"), (F.col("end") - len(TAIL)).alias("target_end"))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "shown"))), lambda x: x["shown"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == TRAINED, span))).alias("examples"),
    )


def expanded(conversations: DataFrame) -> DataFrame:
    """An example a row: conv_id, turn_number, context_end, target_start, target_end, reply (escaped, the only trainable part)."""
    e = conversations.select("conv_id", "formatted", F.inline("examples"))
    return e.select("conv_id", "turn_number", "context_end", "target_start", "target_end", F.expr("substring(formatted, int(target_start) + 1, int(target_end - target_start))").alias("reply"))


def with_prompts(conversations: DataFrame) -> DataFrame:
    """As expanded, and prompt: all of the conversation before the reply, its mark included."""
    texts = conversations.select(F.col("conv_id").alias("c"), "formatted")
    e = expanded(conversations)
    return e.join(texts, e["conv_id"].eqNullSafe(F.col("c"))).select(*e.columns, F.expr("substring(formatted, 1, int(target_start))").alias("prompt"))


def turns_of(text: Column) -> Column:
    """The (role, text) of each turn in a formatted text, in order."""
    pieces = F.split(text, TAIL)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), MIDDLE, 1)).alias("role"),
            unescaped(F.substr(p, F.instr(p, F.lit(MIDDLE)) + len(MIDDLE))).alias("text"),
        ),
    )


def digests(conversations: DataFrame, examples: DataFrame) -> DataFrame:
    """What formatted() and expanded() have written, read back."""
    turns = conversations.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns_of(F.col("formatted")).alias("turns")).select(
        "conv_id",
        "formatted_chars",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    replies = examples.groupBy(F.col("conv_id").alias("c")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_number", unescaped(F.col("reply")).alias("reply")))), lambda x: x["reply"]), "").alias("loss"),
        F.count("*").alias("n_examples"),
        F.sum("target_end").alias("expanded_chars"),
    )
    replies = replies.select("c", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "n_examples", "expanded_chars")
    joined = turns.join(replies, turns["conv_id"].eqNullSafe(F.col("c")), "left")
    none = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return joined.select("conv_id", "n_turns", "turns_sha256", none("loss_chars"), F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"), "formatted_chars", none("n_examples"), none("expanded_chars"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise(TRAINED), F.lit(PROBE_TEXT))
    conversations = written(formatted(turns.union(probe)), "chat")
    return digests(conversations, written(expanded(conversations), "examples"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 22 AS size FROM t
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples,
  CAST(coalesce(sum(upto - 8) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS expanded_chars
FROM p GROUP BY conv_id
"""
