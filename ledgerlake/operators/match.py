"""Finding entities and topics by text or vector."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlake.functions.jsonx import cosine
from ledgerlake.functions.text import contains_either_way, expand, overlap, tokens

#: Vectors of a block, about, and rows of it in one matrix product.
BLOCK_VECTORS, SLICE = 4096, 256


def fuzzy(entities: DataFrame, surface: Column, query: str, key: Sequence[Column], limit: int = 10) -> DataFrame:
    """The entities whose surface shares most tokens with the query, score over zero, ties in order of key. A null surface never matches."""
    score = overlap(F.array_distinct(tokens(expand(F.lit(query)))), tokens(surface))
    return entities.withColumn("match_score", score).where("match_score > 0").orderBy(F.desc("match_score"), *key).limit(limit)


def first_topic(questions: DataFrame, question: str, topics: Sequence[tuple[int, str]], name: str) -> DataFrame:
    """Each question with the position of the first topic of which an alias is in it or that it is in; null without one. topics: (position, alias) of a small list of reference texts."""
    hits = F.array_compact(F.array(*(F.when(contains_either_way(F.lit(alias), F.col(question)), F.lit(at)) for at, alias in topics)))
    return questions.withColumn(name, F.array_min(hits) if topics else F.lit(None).cast("int"))


def topic_search(questions: DataFrame, key: str, question: str, topics: Sequence[tuple[int, str]], vectors: DataFrame, topic_vectors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """key, topic, how (alias, vector or not found) and score: a topic by its text, else the one of the nearest vector if that is near enough.

    vectors: key and vector of questions; topic_vectors: position and vector of topics, as many as there are topics. Of equally near topics the first one.
    """
    found = first_topic(questions, question, topics, "topic")
    held = F.broadcast(topic_vectors.agg(F.sort_array(F.collect_list(F.struct("position", "vector"))).alias("__all")))
    near = F.array_max(F.transform("__all", lambda t: F.struct(cosine(F.col("vector"), t["vector"]).alias("score"), (-t["position"]).alias("at"))))
    asked = found.where("topic IS NULL").join(vectors, key, "left").join(held).withColumn("near", near)
    close = F.col("near.score") >= threshold
    rest = asked.select(key, F.when(close, -F.col("near.at")).alias("topic"), F.when(close, "vector").otherwise("not found").alias("how"), F.round(F.col("near.score"), 4).alias("score"))
    return found.where("topic IS NOT NULL").select(key, "topic", F.lit("alias").alias("how"), F.lit(None).cast("double").alias("score")).union(rest.select(key, F.col("topic").cast("int"), "how", "score"))


def fallback(names: Column, wanted: str, suffix: str) -> Column:
    """1: equal, 2: contains, 3: contains without the suffix, any case; null: no match."""
    low, w = F.lower(names), wanted.lower()
    short = w.removesuffix(suffix.lower()).strip()
    return F.when(low == w, 1).when(low.contains(w), 2).when(low.contains(short), 3)


def _best_of_blocks(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and score of the best other vector in y for each of x; equal at 6 digits: the least key. x and y in slices, so no product of whole blocks is held."""
    order = np.argsort(ky, kind="stable")
    y, ky, out = y[order].T.copy(), ky[order], []
    for i in range(0, len(x), SLICE):
        s = x[i : i + SLICE] @ y
        s[kx[i : i + SLICE, None] == ky] = -np.inf
        row, col = np.nonzero(s >= s.max(axis=1, keepdims=True) - 1e-6)
        score = s[row, col]
        row, col, score = row[score > -np.inf], col[score > -np.inf], score[score > -np.inf]
        by = np.lexsort((col, -np.floor(score * 1e6 + 0.5), row))
        first = by[np.unique(row[by], return_index=True)[1]]
        out.append((row[first] + i, order[col[first]], score[first]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def vector_top1(vectors: DataFrame, key: str, vector: str, threshold: float = 0.5) -> DataFrame:
    """The neighbour of each vector with the greatest cosine over all vectors, itself excluded; whether that reaches the threshold. A zero vector has cosine 0 with all.

    Exact: rows are dealt into blocks by key, every block meets every other one in a matrix product,
    and the best of each pair of blocks is all that leaves a task. Rows without a key or vector are not compared.
    """
    rows = vectors.select(F.col(key), F.col(vector).alias("__v")).where(F.col(key).isNotNull() & F.col("__v").isNotNull())
    blocks = -(-rows.count() // BLOCK_VECTORS) or 1
    block, every = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("__a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__b")
    a = rows.select(key, "__v", block, every)
    b = rows.select(F.col(key).alias("__k"), F.col("__v").alias("__w"), every.alias("__x"), block.alias("__y"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({f.name: pa.array([], f.type) for f in to_arrow_schema(schema)})
        parts = [(t.column(k).combine_chunks(), t.column(v).combine_chunks()) for t, k, v in ((left, key, "__v"), (right, "__k", "__w"))]
        (kx, x), (ky, y) = ((k, v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)) for k, v in parts)
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
        i, j, s = _best_of_blocks(x, y, kx.to_numpy(zero_copy_only=False), ky.to_numpy(zero_copy_only=False))
        return pa.table({key: kx.take(pa.array(i)), "neighbour": ky.take(pa.array(j)), "s": pa.array(s)})

    of = rows.schema[key].dataType
    schema = T.StructType([T.StructField(key, of), T.StructField("neighbour", of), T.StructField("s", T.DoubleType())])
    scored = a.groupBy("__a", "__b").cogroup(b.groupBy("__x", "__y")).applyInArrow(best, schema).select(key, "neighbour", F.round("s", 6).alias("score"))
    top = scored.groupBy(key).agg(F.max_by(F.struct("score", "neighbour"), F.struct("score", -F.col("neighbour"))).alias("best"))
    return top.select(key, F.col("best.neighbour").alias("neighbour"), F.round("best.score", 4).alias("score"), (F.col("best.score") >= threshold).cast("int").alias("matched"))
