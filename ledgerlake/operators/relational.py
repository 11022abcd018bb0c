"""Row-order operators as windows and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. order must be total."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; the limit is pushed below the shuffle by the planner."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def take_while(df: DataFrame, key: Sequence[str], order: Sequence[Column], stop: Column) -> DataFrame:
    """Rows of each key before the first where stop holds."""
    seen = F.max(stop.cast("int")).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("__stop", seen).where("__stop = 0").drop("__stop")


def between_anchors(df: DataFrame, key: Sequence[str], at: Column, start: Column, end: Column) -> DataFrame:
    """Rows of each key after the first start and before the first end behind it; without an end, all after the start."""
    w = W.partitionBy(*key)
    df = df.withColumn("__from", F.min(F.when(start, at)).over(w))
    df = df.withColumn("__to", F.min(F.when(end & (at > F.col("__from")), at)).over(w))
    return df.where((at > F.col("__from")) & (F.col("__to").isNull() | (at < F.col("__to")))).drop("__from", "__to")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with `values` of the last right row of its key at or before it; null without one.

    One union and one window, so it costs a sort a key and never pairs of rows. Right rows
    with the same time: the one with the greatest values.
    """
    row = F.struct(F.col(right_at).alias("at"), *values)
    a = left.select(F.col(key).alias("__k"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("__r"))
    b = right.select(F.col(key), F.col(right_at), F.lit(0), F.lit(None).cast(a.schema["__l"].dataType), row)
    w = W.partitionBy("__k").orderBy("__at", "__side", F.col("__r").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    found = a.union(b).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("__l.*", *(F.col(f"__last.{v}").alias(v) for v in values))


def nearest_value(x: Column, to: Sequence[float]) -> Column:
    """Which of `to` is nearest; the first of equally near ones."""
    best = F.array_min(F.array(*(F.struct(F.abs(x - F.lit(float(v))).alias("d"), F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(to))))
    return best["v"]


def valid_at(facts: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Facts with the span of their key that holds at their time; an open end is null. Spans of a key do not overlap: the last one that starts by then is the only one that can hold, so no pairs are made."""
    values = [c for c in spans.columns if c != key]
    found = as_of(facts, spans.where(F.col(start).isNotNull()), key, at, start, values)
    return found.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def first_page_with(words: DataFrame, doc: str, page: str, text: str, anchor: str) -> DataFrame:
    """The words of the first page of each document on which some word contains the anchor."""
    hit = F.min(F.when(F.col(text).contains(anchor), F.col(page))).over(W.partitionBy(doc))
    return words.withColumn("__p", hit).where(F.col(page) == F.col("__p")).drop("__p")


def digits(c: Column, n: int = 6) -> Column:
    """A number with n significant digits."""
    x = c.cast("double")
    scale = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | F.isnan(x), x).otherwise(F.round(x * scale, 0) / scale)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with how often, of one side that the other lacks; side is 'left' or 'right'. Doubles and floats count as equal if six digits are."""
    a, b = (x.select(*(digits(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in x.dtypes)) for x in (a, b))
    count = lambda x, s: x.groupBy(*x.columns).agg(F.count("*").alias("__n")).withColumn("__s", F.lit(s))
    both = count(a, 1).union(count(b, -1)).groupBy(*a.columns).agg(F.sum(F.col("__n") * F.col("__s")).alias("__d")).where("__d <> 0")
    return both.select(*a.columns, F.when(F.col("__d") > 0, "left").otherwise("right").alias("side"), F.abs("__d").alias("n"))
