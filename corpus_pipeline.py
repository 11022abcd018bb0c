"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
A stage begins with heaps that hold nothing of the one before.

1. toxicity: documents with a score of 0.7 or more go.
2. near-dedup: of each class that links of similarity 0.8 or more over 5-word shingles connect, the
   document with the least doc_id stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. mixing: no document goes; they are put in the order of the mixture, and the files keep it.
5. token ids: a content-addressed store in that order. The result is read back from it:
   doc_id, start (ids of all documents before it in the mixture), n_tokens, ids_crc32.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, mixing, near_copies, token_store, toxicity
from ledgerlake.llm.common import new_path, release_heaps, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_heaps(spark)
    return toxicity.clean_rows(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_heaps(spark)
    return near_copies.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_heaps(spark)
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_heaps(spark)
    return mixing.in_mixed_order(docs)


def in_file_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns that order its rows as its files hold them, and their names; doc_id alone where docs are not read from files."""
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    try:
        return docs.select("doc_id", "text", number(r"part-(\d+)").alias("file_part"), number(r"-c(\d+)").alias("file_piece"), F.col("_metadata.row_index").alias("file_row")), ["file_part", "file_piece", "file_row", "doc_id"]
    except AnalysisException:
        return docs.select("doc_id", "text"), ["doc_id"]


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release_heaps(spark)
    placed, order = in_file_order(docs)
    path = new_path(spark, "tokens")
    token_store.write_store(placed, path, order)
    release_heaps(spark)
    token_store.verify(spark, path)
    return token_store.digests(spark, path, order).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_ids", write_ids),
]

#: Learned weights, fingerprints and a tokenizer: beyond SQL. tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
