"""Connected components of an edge table, without collecting it: large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import drop_written, written


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Large: each node's larger neighbours move to its least neighbour; small: its smaller ones and itself do. A table.

    Least neighbours are written first: both sides of the join are plain exchanges then, so
    the rows of a hub that has a large part of all edges can be split.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where("v < u")
    least = written(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = written(out.where("u <> v").distinct(), name)
    drop_written(least)
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of each node that an edge (u, v) of long numbers touches; root: the least node it reaches.

    Every round is written to the shared folder, so lineage stays short; rounds end when
    each node points at its root. No edge: an empty table.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark, half = seen, _star(now, True, name)
        drop_written(now)
        now = _star(half, False, name)
        drop_written(half)
