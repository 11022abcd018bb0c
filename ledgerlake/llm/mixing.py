"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in order of doc_id, are cut into blocks of `block_rows`. Slot t of
the mixture takes one block. In the ideal mixture every source that has blocks left is
served at once, in proportion to its weight, so the ideal time t(v) at which sources have
been served w * v blocks each is the sum of min(w * v, blocks) over the sources: exhausted
sources leave their share to the others without a restart. Block i of a source is released
at floor(t(i / w)) and due at ceil(t((i + 1) / w)), and each slot takes the released block
with the earliest deadline. The ideal mixture shows that all deadlines can be met, so
earliest deadline first meets them: at any slot a source is less than one block off. All
this is reckoned in whole numbers from the given weights, none is rounded.

What goes to the driver is a count for each source, and a row for each block. Unless
`block_rows` is given, blocks have BLOCK_ROWS rows, or as many as make MOST_BLOCKS blocks in
all (and one for each source), so that this stays bounded; with a block of rows at least
for each, any number of sources can be mixed that the driver can hold counts of.

Ranks within a source come from a range partitioning by (source, doc_id): the row number
within a partition plus the counts of earlier partitions. A hot source spreads over as
many partitions as its rows need; no window spans a source's rows.

Defined cases: a null source is a source of its own, a null doc_id comes first; rows that
repeat (source, doc_id) share one place and stay together; weights for sources that have
no rows are ignored; sources without a given weight follow, with equal weights, when the
others are exhausted; negative and infinite weights are refused; an empty table gives an
empty result; further columns are ignored, and `in_mixed_order` returns them untouched.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction
from itertools import accumulate
from math import isfinite, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.common import table, written

BLOCK_ROWS = 32
#: Blocks in a plan, about, unless block_rows says otherwise: larger tables have larger blocks.
MOST_BLOCKS = 1 << 18
#: Default weights: shares of rows to this power, so that large sources count less than they hold.
TEMPERATURE = 0.7

Windows = dict[str | None, list[tuple[int, int]]]


def windows(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> Windows:
    """(release, deadline) of each block of each source."""
    if bad := [w for w in weights.values() if w is not None and not (w >= 0 and isfinite(w))]:
        raise ValueError(f"weights are finite and not negative, not {bad[0]}")
    live = {s: n for s, n in blocks.items() if n > 0}
    first = {s: Fraction(weights.get(s) or 0) for s in live}
    out: Windows = {}
    base = 0
    for group in ({s: w for s, w in first.items() if w}, {s: Fraction(1) for s, w in first.items() if not w}):
        if not group:
            continue
        scale = lcm(*(w.denominator for w in group.values()))
        whole = {s: int(w * scale) for s, w in group.items()}
        order = sorted(group, key=lambda s: Fraction(live[s], whole[s]))
        ends = [live[s] / whole[s] for s in order]  # when, on the scale of v, a source is exhausted
        gone = [0, *accumulate(live[s] for s in order)]
        served = [sum(whole.values())]
        for s in order:
            served.append(served[-1] - whole[s])
        for k, s in enumerate(order):
            n, w = live[s], whole[s]
            at = [min(k, bisect_right(ends, i / w)) for i in range(n + 1)]
            release = [base + gone[j] + i * served[j] // w for i, j in enumerate(at[:-1])]
            due = [base + gone[j] - (-i * served[j] // w) for i, j in enumerate(at) if i]
            out[s] = list(zip(release, due, strict=True))
        base += gone[-1]
    return out


def earliest_deadline_first(of: Windows) -> dict[str | None, list[int]]:
    """The slot of each block of each source; ties go to the source that comes first."""
    names = list(of)
    waiting = [(of[s][0][0], k, 0) for k, s in enumerate(names) if of[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out: dict[str | None, list[int]] = {s: [] for s in names}
    for t in range(sum(map(len, of.values()))):
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (of[names[k]][i][1], k, i))
        _, k, i = heapq.heappop(ready)
        out[names[k]].append(t)
        if i + 1 < len(of[names[k]]):
            heapq.heappush(waiting, (of[names[k]][i + 1][0], k, i + 1))
    return out


def plan_of(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> pa.Table:
    """of (the source), at (the block), slot, release_slot and deadline_slot of each block."""
    of = windows(blocks, weights)
    slots = earliest_deadline_first(of)
    rows = [(s, i, slot, *window) for s, ws in of.items() for i, (slot, window) in enumerate(zip(slots[s], ws, strict=True))]
    schema = pa.schema([("of", pa.string()), *((c, pa.int64()) for c in ("at", "slot", "release_slot", "deadline_slot"))])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema) if rows else schema.empty_table()


def ranked(docs: DataFrame) -> DataFrame:
    """source, doc_id, copies and rank (within the source, from 0) of each distinct (source, doc_id), as a table in the shared folder."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("source", "doc_id").repartitionByRange(n, "source", "doc_id").groupBy("source", "doc_id").agg(F.count("*").alias("copies"))
    at = F.monotonically_increasing_id()
    keys = written(keys.sortWithinPartitions("source", "doc_id").withColumn("at", at).select("*", F.shiftrightunsigned("at", 33).alias("part")), "ranked")
    counts = keys.groupBy("part", "source").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))  # a row a partition and source in it
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("part").alias("p"), F.col("source").alias("s"), "first_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = keys.join(counts, (keys["part"] == F.col("p")) & keys["source"].eqNullSafe(F.col("s")))
    return joined.select("source", "doc_id", "copies", (F.col("offset") + F.col("at") - F.col("first_at")).alias("rank"))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """The place of each distinct (source, doc_id): block, slot, window and position in the mixture."""
    spark = docs.sparkSession
    ranks = ranked(docs)
    counts = {r["source"]: r["n"] for r in ranks.groupBy("source").agg(F.count("*").alias("n")).collect()}
    counts = dict(sorted(counts.items(), key=lambda x: (x[0] is not None, x[0] or "")))
    size = int(block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS)))
    weights = weights if weights is not None else {s: n**TEMPERATURE for s, n in counts.items()}
    plan = spark.createDataFrame(plan_of({s: -(-n // size) for s, n in counts.items()}, weights))
    r = ranks.withColumn("block", F.expr(f"rank div {size}"))
    placed = r.join(plan, r["source"].eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    return placed.select("doc_id", "source", "copies", "block", "slot", "release_slot", "deadline_slot", (F.col("slot") * size + F.col("rank") % size).alias("position"))


def in_mixed_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """All rows and columns of docs, sorted by their place in the mixture; written as Parquet, files and rows keep that order."""
    places = mixed(docs, weights, block_rows).select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("position").alias("__position"))
    joined = docs.join(places, docs["doc_id"].eqNullSafe(F.col("__d")) & docs["source"].eqNullSafe(F.col("__s")))
    return joined.orderBy("__position").select(*(docs[c] for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
