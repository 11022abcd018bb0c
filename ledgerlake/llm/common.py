"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in an Arrow batch that goes to Python. Long texts make batches of the default size too large for a small executor.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new temporary one only where that is unset (local tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release_shuffles(spark)
    return spark.read.parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished plans when the driver's garbage is collected; else they fill the disks up to the end of a job."""
    gc.collect()
    spark._jvm.System.gc()


#: Seconds between two collections of the executors' garbage, at least.
HEAPS_S = 5.0
_heaps_released: dict[str, float] = {}


def release_heaps(spark: SparkSession) -> None:
    """A full collection on the executors, at most every HEAPS_S seconds. Else heaps grow to their limit by the garbage of finished plans and keep that memory, beside what later plans need out of the heap and for Python."""
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _heaps_released.get(app, -HEAPS_S) >= HEAPS_S:
        n = spark.sparkContext.defaultParallelism  # a task a core: all executors get some
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
        _heaps_released[app] = time.monotonic()


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of written() once no later plan reads it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that written() returned once no later plan reads them."""
    for df in tables:
        if files := df.inputFiles():
            drop_path(df.sparkSession, files[0].rpartition("/")[0])


#: log2 of the bits of a bitmap: 16 MB whatever the input. One that fills up lets more through and loses nothing.
BITMAP = 27


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """2 ** BITMAP bits, set at the leading bits of each hash (long). At most 2 ** (BITMAP - 6) rows come to the driver."""
    at = F.shiftrightunsigned(column, 64 - BITMAP)
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned({column}, {64 - BITMAP}) & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def let_through(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) have their bit set."""
    at = h >> np.uint64(64 - BITMAP)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class WordHashes(dict):
    """A word's 64-bit hash; forgets all at a bound, so that memory is bounded."""

    MOST = 250_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


#: One for all operators, as a worker runs several in turn.
word_hashes = WordHashes()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bounded_labels(labels: DataFrame, value: str, limit: int) -> DataFrame:
    """At most `limit` labelled doc_ids, those of the smallest hash; a doc_id labelled twice counts as the larger label."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).groupBy("doc_id").agg(F.max(value).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def map_texts(df: DataFrame, keep: list[str], text: str, run: Callable[[list[str]], dict[str, list]], schema: str) -> DataFrame:
    """The columns `keep` as they are and those of `schema`, which `run` makes of a batch of texts (null: empty) in Python.

    Arrow batches: columns kept pass untouched, so nulls and large integers in them survive.
    """
    small_batches(df.sparkSession)
    made = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out = run([x or "" for x in b.column(len(keep)).to_pylist()])
            arrays = [pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *arrays], names=[*keep, *(f.name for f in arrow)])

    slim = df.select(*(df[c] for c in keep), df[text].cast("string").alias("__text"))
    return slim.mapInArrow(batches, T.StructType([*(df.schema[c] for c in keep), *made.fields]))


def keep_rows(df: DataFrame, text: str, test: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows, all columns untouched, whose text (null: empty) passes `test` in Python batches."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            yield b.filter(pa.array(test([x or "" for x in b.column(at).to_pylist()]), pa.bool_()))

    return df.mapInArrow(batches, df.schema)


def flat_map_texts(df: DataFrame, keep: list[str], text: str, run: Callable[[list[str]], tuple[list[int], dict[str, list]]], schema: str) -> DataFrame:
    """As map_texts, with any number of rows for a text: `run` also returns the index in the batch that each of them is of."""
    small_batches(df.sparkSession)
    made = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            of, out = run([x or "" for x in b.column(len(keep)).to_pylist()])
            at = pa.array(of, pa.int64())
            arrays = [*(b.column(i).take(at) for i in range(len(keep))), *(pa.array(out[f.name], f.type) for f in arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f.name for f in arrow)])

    slim = df.select(*(df[c] for c in keep), df[text].cast("string").alias("__text"))
    return slim.mapInArrow(batches, T.StructType([*(df.schema[c] for c in keep), *made.fields]))
