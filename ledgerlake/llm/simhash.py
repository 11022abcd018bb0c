"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits: bit b is set where over half of the XXH64 values of a text's
word shingles, repeats included, have it. Texts link where fingerprints differ in at
most `max_bits` bits; a class is what links connect.

Search. Only distinct fingerprints take part. The 64 bits are dealt into m partitions,
bits that go together in one (correlation over a bounded sample of fingerprints). If
thresholds t_i add up to max_bits - m + 1, two fingerprints within max_bits are within
t_i in some partition i (t_i = -1: the partition is not probed). Dynamic programming
picks m and unequal t_i for the least probes plus estimated candidates at the number of
fingerprints there are, so wider keys are probed as a corpus grows. Fingerprints meet
in the keys probed and are verified in the join's condition.

Dense keys. Near copies fill single keys, where all pairs would grow with the square.
Members of keys over DENSE rows go another, exact way: two fingerprints are within 2
bits if and only if the balls of radius 1 around them meet. Each member emits its 65
neighbours; whatever shares a neighbour links to the least of it (at most 65 members),
so the number of rows is linear and no link between different fingerprints is lost to
connectivity.

Defined cases: a null text counts as empty; texts without a word have fingerprint zero
and link like others; fewer words than a shingle: the whole sequence is one; a repeated
row gets a row each; a null doc_id gets the class of its fingerprint, whose id is the
least that is not null; an empty table gives an empty result; further columns are
ignored, and `one_of_each_class` returns them untouched.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import map_texts, table, written
from ledgerlake.llm.components import components

BITS = 64
SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints that planning looks at, at most.
SAMPLE = 2048
#: Rows of a key up to which its members are compared in pairs.
DENSE = 64
#: Cost of a probe row against a candidate pair.
PROBE_COST = 3.0


def majority(values: np.ndarray) -> int:
    """The bits that over half of the values (uint64) have, as a signed 64-bit number; none of no value."""
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(values), 1 << 14):
        some = np.ascontiguousarray(values[first : first + (1 << 14)])
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    of = xxhash.xxh64_intdigest
    values = np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[len(words) - n :] - 1).tolist(), strict=True)), np.uint64, n)
    return majority(values)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of each row."""
    return map_texts(docs, ["doc_id"], "text", lambda texts: {"fp": [fingerprint(t, shingle) for t in texts]}, "fp long")


def grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal width; each takes the bits most correlated with those it has."""
    spread = bits.std(axis=0) if len(bits) else np.zeros(BITS)
    bond = np.zeros((BITS, BITS))
    if (spread > 0).sum() > 1:
        live = np.flatnonzero(spread > 0)
        bond[np.ix_(live, live)] = np.abs(np.corrcoef(bits[:, live], rowvar=False))
    left, out = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        got = [min(left, key=lambda b: (-bond[b, list(left)].sum(), b))]
        left.discard(got[0])
        while len(got) < width:
            b = min(left, key=lambda b: (-bond[b, got].sum(), b))
            got.append(b)
            left.discard(b)
        out.append(sorted(got))
    return out


def plan(sample: np.ndarray, n: int, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition probed. sample: distinct fingerprints (uint64); n: how many there are in all."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(sample) else np.zeros((0, BITS), np.uint8)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, max_bits + 2):
        parts = grouped_bits(bits, m)
        cost: list[dict[int, float]] = []
        for part in parts:
            x = bits[:, part].astype(np.float32)
            near = np.zeros(len(part) + 1, np.int64)
            for some in (x[i : i + 256] for i in range(0, len(x), 256)):  # in blocks: the driver is small
                near += np.bincount(np.rint(some @ (1 - x).T + (1 - some) @ x.T).astype(np.int64).ravel(), minlength=len(part) + 1)
            near[0] -= len(x)  # with itself
            near = (near // 2).cumsum()
            of = {-1: 0.0}
            for t in range(min(max_bits, len(part)) + 1):
                keys = sum(comb(len(part), j) for j in range(t + 1))
                share = max(near[t] / pairs, keys / 2.0 ** len(part))
                of[t] = PROBE_COST * n * keys + share * n * n / 2
            cost.append(of)
        sums: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for of in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in sums.items():
                for t, more in of.items():
                    if s + t not in step or c + more < step[s + t][0]:
                        step[s + t] = (c + more, [*ts, t])
            sums = step
        if (total := max_bits - m + 1) in sums and sums[total][0] < best[0]:
            best = (sums[total][0], [(p, t) for p, t in zip(parts, sums[total][1], strict=True) if t >= 0])
    return best[1]


def _signed(bits: tuple[int, ...] | list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(c) for k in range(most + 1) for c in combinations(bits, k)]


def _xors(values: list[int]) -> Column:
    return F.transform(F.array(*(F.lit(v).cast("long") for v in values)), lambda x: F.col("fp").bitwiseXOR(x))


def _keys(part: int, bits: list[int], most: int) -> Column:
    """The keys that a fingerprint probes in a partition; `own`: the one it is held under."""
    key = F.col("fp").bitwiseAND(F.lit(_signed(bits)).cast("long"))
    flips = F.array(*(F.lit(v).cast("long") for v in _flips(bits, most)))
    return F.transform(flips, lambda x: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(x).alias("key"), (x == 0).alias("own")))


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints `fp` of nodes within max_bits (0 to 2); not each pair has one of its own."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    spark = nodes.sparkSession
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, nodes.count(), max_bits)
    keys = [_keys(i, bits, t) for i, (bits, t) in enumerate(parts)]
    probes = nodes.select("fp", F.inline(F.concat(*keys)))
    counts = written(probes.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("own").alias("held")).where("n > 1 AND held"), "keys")  # a table: a dense key's rows can be split in the join
    met = written(probes.join(counts, ["part", "key"]).select("part", "key", "own", "fp", (F.col("n") > DENSE).alias("dense")), "met")
    a = met.where("own AND NOT dense").select("part", "key", F.col("fp").alias("u"))
    b = met.where("NOT dense").select("part", "key", F.col("fp").alias("v"), F.col("own").alias("too"))
    within = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    found = a.join(b, (a["part"] == b["part"]) & (a["key"] == b["key"]) & within & (F.col("u") != F.col("v")) & (~F.col("too") | (F.col("u") < F.col("v")))).select("u", "v")
    crowd = met.where("dense").select("fp").distinct()
    ball = crowd.select("fp", F.explode(_xors(_flips(list(range(BITS)), 1))).alias("z"))
    if max_bits == 2:
        shared = ball.groupBy("z").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
        star = shared.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    else:
        star = ball.join(crowd.withColumnRenamed("fp", "v"), F.col("z") == F.col("v")).select(F.col("fp").alias("u"), "v") if max_bits else spark.createDataFrame([], "u long, v long")
    return found.union(star).where("u <> v")


def classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = written(components(links(nodes, max_bits), "edges"), "roots")
    named = nodes.join(roots, nodes["fp"] == roots["node"])
    least = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    moved = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    ids = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    ids = written(ids, "ids")  # both sides of the join are plain exchanges then, so a hot fingerprint's partition can be split
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def one_of_each_class(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the least of its class; of rows with the same doc_id and class all stay or go. Rows without a doc_id stay."""
    gone = classes(docs.where("doc_id IS NOT NULL"), shingle, max_bits).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", hex_of().alias("fingerprint"), "component_id")
