"""Readers and writers of tables and reference files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.plans.guard import TABLES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables."""
    for name in names or TABLES:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def csv_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header: cells trimmed, blank ones null, rows with a blank first column dropped."""
    rows = spark.read.csv(path, header=True, schema=schema)
    clean = rows.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    return clean.where(F.col(rows.columns[0]).isNotNull())


def json_topics(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The entries of {"topics": [...]}; malformed files give none."""
    return spark.read.json(path, multiLine=True, mode="PERMISSIVE", schema=f"topics array<struct<{item}>>").select(F.inline("topics"))


def files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """name, key (name without extension), size and SHA-256 of each file, in order of name."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("key"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("name")


def publish(tables: dict[str, DataFrame], folder: str, batch: str) -> None:
    """All tables or none: written to a folder of the batch, visible once its manifest is renamed into place."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/batches/{batch}/{name}")
    manifest = spark.createDataFrame([(batch, n) for n in sorted(tables)], "batch string, name string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/staged/{batch}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/manifests"))
    if not fs.rename(path(f"{folder}/staged/{batch}"), path(f"{folder}/manifests/{batch}")):
        raise OSError(f"batch {batch} could not be published")


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of all batches that a manifest names."""
    batches = [r["batch"] for r in spark.read.json(f"{folder}/manifests/*", schema="batch string, name string").where(F.col("name") == name).distinct().orderBy("batch").collect()]
    return spark.read.option("mergeSchema", "true").parquet(*(f"{folder}/batches/{b}/{name}" for b in batches))
