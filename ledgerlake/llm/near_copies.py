"""Near copies: all pairs of texts with a Jaccard similarity of 0.8 or more over 5-word shingles.

SimHash comes first. Each set of shingles has a fingerprint; the generalised pigeonhole
search of simhash.py links those within its MAX_BITS bits, and sets of one fingerprint
are linked to the least of them. Links count where the whole sets are similar, and make
the first classes. A 64-bit SimHash alone cannot hold the promise: texts of similarity 0.8
differ in about ten bits, where keys of a pigeonhole plan are a few bits wide and meet
nearly all texts. What it leaves apart is searched in the shingle sets themselves, by
prefix filtering. Each set is sorted in one global order; two sets of n and m shingles
that are similar enough share a shingle among the first n - ceil(0.8 n) + 1 of the one
and the first m - ceil(0.8 m) + 1 of the other. Sizes, the places of the shared shingle
and signatures of BITS bits bound the overlap, and what passes is verified on the whole
sets.

The order puts frequent shingles last, by levels of how many rows hold them, counted in
all rows. It changes the cost and no result. A bounded sample would not do: what it
misses is in ever more rows as a corpus grows, and its pairs grow with the square. The
levels are two bitmaps of 16 MB; as these fill up, shingles rank higher than they should
and none is lost. What is wanted are classes, so pairs that are linked already, by
SimHash or in an earlier round, need no comparison. In each round the sets of a key are compared with a few pivots of it, those
of the classes that have the fewest sets there, and only where the classes differ. Then
links are put together to classes, pivots leave the key, and a key whose sets are all of
one class is done. A group of near copies is one class after a round, so its rows grow
with its size and not with the square. The pivots of a key grow fourfold a round, so
that keys whose sets stay apart come to an end too.

Defined cases: as simhash. Words are those of simhash; a text of fewer words than a
shingle is one shingle, and texts without a word are copies of each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm import simhash
from ledgerlake.llm.common import BITMAP, WordHashes, bitmap_of, drop_written, flat_map_texts, let_through, map_texts, release_heaps, release_shuffles, small_batches, written
from ledgerlake.llm.components import components

SHINGLE = 5
#: From how many rows on a shingle is of level 1, 2 and 3.
OFTEN = (2, 8, 64)
#: Bits of a signature; a power of two.
BITS = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_words = WordHashes()
#: Pivots of a key grow so many times a round, from one.
GROWTH = 4


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, sorted. Words are lower-cased in A-Z and split at ASCII white space, as in simhash."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return np.zeros(0, np.int64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for j in range(min(size, len(h))):
        out = (out ^ h[j : j + n]) * _ODD
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def signature(h: np.ndarray) -> np.ndarray:
    """BITS bits, set where a hash of the set falls: sets differ in as many shingles at least as their signatures in bits."""
    bits = np.zeros(BITS, np.uint8)
    bits[h & (BITS - 1)] = 1
    return np.packbits(bits).view(np.int64)


def _set_id(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes()) - 2**63


def levels(docs: DataFrame) -> np.ndarray:
    """In how many rows each shingle is, counted in all of docs: two bitmaps, as let_through reads them, of the low and the high bit of its level in OFTEN; the highest of those that share a bit.

    Hashes go to parts by their leading bits, as sorted runs, and a part's come to one task
    in turn: Python holds a batch or a part, the driver 32 MB whatever the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bits = min(17, max(10, (docs.count() >> 14).bit_length()))
    starts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def dealt(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            made = {_set_id(h): h for h in (shingles(t or "") for t in b.column(0).to_pylist())}
            h = np.sort(np.concatenate([np.zeros(0, np.int64), *made.values()]).view(np.uint64))
            runs = [(i, r.tobytes()) for i, r in enumerate(np.split(h, np.searchsorted(h, starts))) if len(r)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], names=["part", "hs"])

    def planes(part: int, runs: list[bytes]) -> pa.RecordBatch:
        h, n = np.unique(np.frombuffer(b"".join(runs), np.uint64), return_counts=True)
        at = (h >> np.uint64(64 - BITMAP)).astype(np.int64) & ((1 << (BITMAP - bits)) - 1)
        level = np.zeros(1 << (BITMAP - bits), np.uint8)
        for i, least in enumerate(OFTEN):
            level[at[n >= least]] = i + 1
        low, high = (zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1) for x in (level & 1, level >> 1))  # mostly zeros
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([low], pa.binary()), pa.array([high], pa.binary())], names=["part", "low", "high"])

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, r) for b in source for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for part, own in groupby(rows, lambda x: x[0]):
            yield planes(part, [r for _, r in own])

    runs = docs.select(F.col("text").cast("string")).mapInArrow(dealt, "part int, hs binary")
    rows = runs.repartition("part").sortWithinPartitions("part").mapInArrow(counted, "part int, low binary, high binary").toArrow()
    out = np.zeros((2, 1 << bits, 1 << (BITMAP - bits - 6)), np.uint64)
    for part, low, high in zip(*(rows[c] for c in ("part", "low", "high")), strict=True):
        for plane, x in zip(out, (low, high), strict=True):
            plane[part.as_py()] = np.frombuffer(zlib.decompress(x.as_py()), np.uint64)
    return out.reshape(2, -1)


def set_ids(docs: DataFrame) -> DataFrame:
    """doc_id, set_id (equal for equal sets), n (shingles), fp (SimHash) and bits (signature) of each row."""

    def run(texts: list[str]) -> dict[str, list]:
        hs = list(map(shingles, texts))
        return {"set_id": list(map(_set_id, hs)), "n": list(map(len, hs)), "fp": [simhash.majority(h.view(np.uint64)) for h in hs], "bits": list(map(signature, hs))}

    return map_texts(docs, ["doc_id"], "text", run, "set_id long, n int, fp long, bits array<long>")


def prefixes(docs: DataFrame) -> DataFrame:
    """key, set_id, n and at (place in the global order): shingles of which similar sets share one, without those that no other row has. A set may come once a batch."""
    sent = docs.sparkSession.sparkContext.broadcast(levels(docs))
    release_shuffles(docs.sparkSession)
    release_heaps(docs.sparkSession)

    def run(texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        low, high = sent.value
        cols: list[tuple] = [(np.zeros(0, np.int64),) * 4]
        for name, h in {_set_id(h): h for h in map(shingles, texts) if len(h)}.items():
            level = let_through(low, h.view(np.uint64)) + 2 * let_through(high, h.view(np.uint64))
            first = np.argsort(level, kind="stable")[: len(h) - -(-4 * len(h) // 5) + 1]
            at = np.flatnonzero(level[first])
            cols.append((h[first[at]], np.full(len(at), name), np.full(len(at), len(h)), at))
        key, name, n, at = (np.concatenate(c) for c in zip(*cols, strict=True))
        return np.zeros(len(key), np.int64), {"key": key, "set_id": name, "n": n.astype(np.int32), "at": at.astype(np.int32)}

    return flat_map_texts(docs, [], "text", run, "key long, set_id long, n int, at int")


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """set_id and hs of the sets in ids (set_id and first_id, a document of it), and few others; made anew from texts, without moving these."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(F.xxhash64("first_id").alias("h")), "h"))
    small_batches(docs.sparkSession)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            b = b.filter(pa.array(let_through(sent.value, b.column(0).to_numpy().view(np.uint64))))
            made = {_set_id(h): h for h in (shingles(t or "") for t in b.column(1).to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(list(made.values()), pa.list_(pa.int64()))], names=["set_id", "hs"])

    return docs.select(F.xxhash64("doc_id"), F.col("text").cast("string")).mapInArrow(batches, "set_id long, hs array<long>")


def _similar(overlap: Column, n: Column, m: Column) -> Column:
    """Whether the overlap of sets of n and m makes a similarity of 4 / 5 or more."""
    return 9 * overlap >= 4 * (n + m)


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) that may be similar by what their signatures differ in."""
    left, right = (nodes.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "uv")
    apart = F.aggregate(F.zip_with("bits_u", "bits_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(left, "u").join(right, "v").where(9 * apart <= F.col("n_u") + F.col("n_v")).select("u", "v")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar."""
    left, right = sets.select(F.col("set_id").alias("u"), F.col("hs").alias("a")), sets.select(F.col("set_id").alias("v"), F.col("hs").alias("b"))
    return pairs.join(left, "u").join(right, "v").where(_similar(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select("u", "v")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar, as a table; that of pairs is dropped."""
    near = written(_near(pairs, nodes), "near")
    release_heaps(docs.sparkSession)
    live = near.select(F.explode(F.array("u", "v")).alias("set_id")).distinct()
    held = written(whole_sets(docs, nodes.select("set_id", "first_id").join(live, "set_id", "left_semi")), "sets")
    release_heaps(docs.sparkSession)
    out = written(_compared(near, held), "linked")
    release_heaps(docs.sparkSession)
    drop_written(held, pairs, near)
    return out


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets within simhash.MAX_BITS bits, enough to connect all of them, as a table."""
    prints = written(nodes.groupBy("fp").agg(F.min("set_id").alias("set_id")), "prints")
    same = nodes.select("fp", F.col("set_id").alias("u")).join(prints.select("fp", F.col("set_id").alias("v")), "fp").select("u", "v")
    left, right = (prints.select(F.col("fp").alias(f"fp_{x}"), F.col("set_id").alias(x)) for x in "uv")
    close = simhash.links(prints.select("fp")).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v"))
    both = same.union(close.join(left, "fp_u").join(right, "fp_v").select("u", "v")).where("u <> v")
    out = written(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    drop_written(prints)
    return out


def _pivots(left: DataFrame, most: int) -> DataFrame:
    """k, u, m, there and its of the pivots of each key: at most `most` sets, of its rarest classes first. left: key, set_id, n, at, root."""
    if most == 1:  # no roots yet
        one = left.groupBy("key").agg(F.min(F.struct("set_id", "n", "at", "root")).alias("p"))
        return one.select(F.col("key").alias("k"), F.col("p.set_id").alias("u"), F.col("p.n").alias("m"), F.col("p.at").alias("there"), F.col("p.root").alias("its"))
    crowd = left.groupBy("key", "root").agg(F.count("*").alias("many"))
    place = F.row_number().over(W.partitionBy("key").orderBy("many", "set_id"))
    few = left.join(crowd, ["key", "root"]).withColumn("place", place).where(F.col("place") <= most)
    return few.select(F.col("key").alias("k"), F.col("set_id").alias("u"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("root").alias("its"))


def _rooted(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """df with the root of the class that a set is in, itself if it is in none."""
    return df.join(roots.select(F.col("node").alias("__n"), F.col("root").alias("__r")), F.col(column) == F.col("__n"), "left").withColumn(name, F.coalesce("__r", column)).drop("__n", "__r")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the classes that all similar sets make; sets without a similar one are left out. nodes: set_id, n, fp, bits and first_id, a document of it."""
    found = _linked(docs, nodes, simhash_pairs(nodes))
    stars = components(found, "edges")
    roots = written(stars, "roots")
    drop_written(stars)
    rows = prefixes(docs).repartition("key").distinct()  # one exchange for the distinct rows, the counts and their join
    counts = rows.groupBy("key").agg(F.count("*").alias("rows_of")).where("rows_of > 1")
    left = written(rows.join(counts, "key").select("key", "set_id", "n", "at", F.col("set_id").alias("root")), "met")
    most = 1
    while not left.isEmpty():
        release_heaps(docs.sparkSession)
        pivots = written(_pivots(left, most), "pivots")
        release_heaps(docs.sparkSession)
        shared = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("there"))  # at most, from this key on
        met = left.join(pivots, (left["key"] == F.col("k")) & (F.col("root") != F.col("its")) & _similar(shared, F.col("n"), F.col("m")))
        pairs = met.select(F.least("set_id", "u").alias("u"), F.greatest("set_id", "u").alias("v")).distinct()
        if most == 1:  # rows of keys have no root yet
            pairs = _rooted(_rooted(pairs, roots, "u", "of_u"), roots, "v", "of_v").where("of_u <> of_v").select("u", "v")
        new = _linked(docs, nodes, written(pairs, "pairs"))
        parts, found = (found, new), written(found.union(new), "links")
        drop_written(*parts)
        stars = components(found, "edges")
        drop_written(roots)
        roots = written(stars, "roots")
        drop_written(stars)
        release_heaps(docs.sparkSession)
        rest = left.join(pivots.select("k", "u"), (left["key"] == F.col("k")) & (left["set_id"] == F.col("u")), "left_anti").drop("root")
        named = written(_rooted(rest, roots, "set_id", "root"), "named")
        drop_written(left, pivots)
        apart = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
        left = written(named.join(apart, "key", "left_semi"), "left")
        drop_written(named)
        most *= GROWTH
    drop_written(left, found)
    return roots


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the least doc_id of its class, of each row."""
    sets = written(set_ids(docs), "shingles")
    nodes = sets.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"))
    nodes = written(nodes, "nodes")
    release_heaps(docs.sparkSession)
    roots = links(docs, nodes)
    least = written(roots.join(nodes, roots["node"] == nodes["set_id"]).groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    moved = roots.join(least, "root").select(F.col("node").alias("set_id"), "component_id")
    ids = written(nodes.join(moved, "set_id", "left").select("set_id", F.coalesce("component_id", "first_id").alias("component_id")), "ids")
    drop_written(nodes, roots, least)
    release_heaps(docs.sparkSession)
    return sets.select("doc_id", "set_id").join(ids, "set_id").select("doc_id", "component_id")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """As simhash.one_of_each_class: the rows whose doc_id is the least of its class, and those without a doc_id."""
    gone = classes(docs.where("doc_id IS NOT NULL")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
