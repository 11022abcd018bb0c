"""Logs, reports and question sets: what runs leave behind, appended and read back."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.operators.snapshot import unknown

#: What a question must have, and of which kinds it may be.
FIELDS = ("id", "category", "question", "expected_answer_contains", "must_refuse", "expected_refusal_reason")
VOLATILE = ("parser_version", "ingested_at", "source_pdf_path", "pdf_sha256", "parse_errors_json", "snapshot_id")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log, none if nothing was appended yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(f"query_id long, {schema}").parquet(path) if there else spark.createDataFrame([], f"query_id long, {schema}")


def numbered(rows: DataFrame, order: Sequence[str], folder: str, last: int = 0) -> DataFrame:
    """rows with query_id, which goes on from `last` in the given order. Ranges of the order are found by a sample, another one each time that the plan runs, so the ranged rows are written to the folder, and both counted and numbered as they stand there."""
    n = max(1, rows.rdd.getNumPartitions())
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged.write.parquet(folder)
    schema = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes)
    ranged = rows.sparkSession.read.schema(schema).parquet(folder)
    ranged = ranged.withColumn("__p", F.shiftrightunsigned("__at", 33)).withColumn("__i", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))  # a row a partition
    before = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), F.col("__p") == F.col("__q")).select((F.lit(last + 1) + F.col("__before") + F.col("__i")).alias("query_id"), *rows.columns)


def append(rows: DataFrame, path: str, order: Sequence[str]) -> tuple[int, int]:
    """Appends rows to a log under ids that follow those it has; the first and the last of them. One writer at a time."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    spark = rows.sparkSession
    last = read_log(spark, path, schema).agg(F.coalesce(F.max("query_id"), F.lit(0))).first()[0]
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-staged-{uuid.uuid4().hex}")
    try:
        numbered(rows, order, staged.toString(), last).write.mode("append").parquet(path)
    finally:
        staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged, True)
    return last + 1, read_log(spark, path, schema).agg(F.coalesce(F.max("query_id"), F.lit(0))).first()[0]


def feedback(log: DataFrame, events: DataFrame, path: str) -> None:
    """Appends feedback events; ValueError, and nothing is written, if one is on a row that the log does not have."""
    if lost := unknown(log, events, "query_id").select("query_id").limit(5).collect():
        raise ValueError(f"no row {', '.join(str(r[0]) for r in lost)} in the log")
    events.write.mode("append").parquet(path)


def report(outcomes: DataFrame, entity: str, status: str) -> DataFrame:
    """One row: the totals of each status and the outcome of each entity, as a JSON report holds them. For reports on a batch of entities, which are held in one row."""
    rows = outcomes.groupBy(status).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(entity, *(c for c in outcomes.columns if c not in (entity, status))))).alias("rows"))
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(status), F.col("n"))))).alias("totals"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(status), F.col("rows"))))).alias("outcomes"), F.sum("n").alias("n"))


def write_report(outcomes: DataFrame, entity: str, status: str, path: str) -> None:
    report(outcomes, entity, status).coalesce(1).write.mode("overwrite").json(path)


def write_transcript(results: DataFrame, path: str) -> None:
    """Results of a run as JSON lines, as many files as there are partitions."""
    results.write.mode("overwrite").json(path)


def chosen(questions: DataFrame, ids: Sequence[str] = (), every: bool = False, default: Sequence[str] = ()) -> DataFrame:
    """The questions with the given ids in their order, all of them, or the default ones; ids that there are none of are left out."""
    if every:
        return questions.withColumn("position", F.row_number().over(W.orderBy("id")))
    wanted = questions.sparkSession.createDataFrame(list(enumerate(ids or default)), "position int, id string")
    return questions.join(F.broadcast(wanted), "id").select(*questions.columns, "position")


def question_faults(questions: DataFrame, categories: Sequence[str], least: Mapping[str, int] | None = None) -> DataFrame:
    """id and fault of each question that is not well-formed, and of each category with too few."""
    of = {
        "no question": F.coalesce(F.trim("question"), F.lit("")) == "",
        "unknown category": ~F.coalesce(F.col("category").isin(*categories), F.lit(False)),
        "a refusal without a reason": F.coalesce("must_refuse", F.lit(False)) & F.col("expected_refusal_reason").isNull(),
        "an answer that expects nothing": ~F.coalesce("must_refuse", F.lit(False)) & (F.coalesce(F.size("expected_answer_contains"), F.lit(0)) <= 0),
        "no id": F.col("id").isNull(),
    }
    faults = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in of.items())))
    rows = questions.select("id", F.explode(faults).alias("fault"))
    twice = questions.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("an id that comes again").alias("fault"))
    out = rows.union(twice)
    if least:
        wanted = questions.sparkSession.createDataFrame(list(least.items()), "category string, least int")
        have = questions.groupBy("category").agg(F.count("*").alias("n"))
        out = out.union(F.broadcast(wanted).join(have, "category", "left").where("coalesce(n, 0) < least").select("category", F.lit("a category with too few").alias("fault")))
    return out


def stable(snapshots: DataFrame, json_columns: Mapping[str, str] | None = None) -> DataFrame:
    """What two runs over the same documents must agree on: without VOLATILE columns, JSON columns parsed by their schemas."""
    parsed = json_columns or {}
    return snapshots.select(*(F.from_json(c, parsed[c]).alias(c) if c in parsed else F.col(c) for c in snapshots.columns if c not in VOLATILE))


def catalog(spark: SparkSession, besides: Sequence[str] = ()) -> DataFrame:
    """name, kind and n_columns of each table and view of the session, without those whose name starts with one of `besides`."""
    rows = [(t.name, t.tableType, len(spark.table(t.name).columns)) for t in spark.catalog.listTables() if not any(t.name.startswith(b) for b in besides)]
    return spark.createDataFrame(rows, "name string, kind string, n_columns int")
