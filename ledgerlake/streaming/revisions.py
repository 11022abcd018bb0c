"""Extensions beyond batch: windowed aggregates and a revisioned upsert over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _timed(events: DataFrame, late: str) -> DataFrame:
    """ts with a time zone, as watermarks want it; the watermark on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day and type; late ones count until the watermark has passed. For streams and tables."""
    rows = _timed(events, late)
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n_events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: runs of events without a pause of `gap`."""
    rows = _timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n_events")


def appended(stream: DataFrame, folder: str) -> DataStreamWriter:
    """Each micro-batch in a folder of its own, written again in full if it is retried; current() folds revisions."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write)


def revised(spark: SparkSession, folder: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows that appended() has written, with revision and superseded_in (the batch of the next one, null for the live row) of each key. order: columns that order rows of one batch."""
    w = W.partitionBy(*key).orderBy("batch", *order)
    return spark.read.parquet(folder).withColumn("revision", F.row_number().over(w)).withColumn("superseded_in", F.lead("batch").over(w))


def current(spark: SparkSession, folder: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The live row of each key: what an upsert would leave."""
    return revised(spark, folder, key, order).where("superseded_in IS NULL").drop("batch", "superseded_in")
