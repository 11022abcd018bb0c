"""Repeated byte strings, removed exactly, by merging Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document
that comes before (smaller doc_id), or before in the same document.

Narrowing. Every window of LENGTH bytes names its anchor, the string of ANCHOR bytes in it
with the least hash; equal windows have equal anchors at equal places. Neighbouring
windows with one anchor are a run, and the bytes they cover are its span. A window can
only repeat if its anchor comes twice, so anchors are counted first, and a bitmap lets
through those that may repeat. Of runs with one span (equal in length and in all 128 bits
of XXH3) the first stays and the others are repeats as a whole. What is contested then are
first spans that share an anchor with another span: borders of passages, edited copies.

Merging. These come together by anchor, with their bytes. Windows of one anchor that start
CELL places apart at most all hold the same bytes in the middle, their core; cores are
looked up as bytes, and a core is one symbol of a span's string, with up to CELL - 1 bytes
on either side. A window is CELL symbols of it. Strings are put in shards, each shard's
suffixes are sorted once, which gives its transform, and transforms are merged by
iterative interleave refinement: a vector that says which shard each row of the merged
transform is from starts as one run a shard, and in each round rows are distributed by
their symbol, stably. After h rounds rows are in order of their first h symbols; the round
in which two neighbours part gives their common prefix. Stretches of the merged transform
with common prefixes of CELL symbols are the intervals of windows that repeat; no suffix
is sorted again, and no hash decides here.

Chunks of a task end at the end of an anchor's spans, except where these alone exceed a
chunk, and spans of an anchor over HOT_SPANS are dealt to several tasks; windows of such
anchors are compared between chunks by their XXH3, with partial sums before the shuffle, so
a passage in a third of all documents meets no single task.

Places. Documents are numbered in order once; a byte's place is one long, the number of
its document and how far into it the byte is, so "earlier" is "smaller". The number of
documents times the length of the longest must stay below 2 ** 63.

Defined cases: a null text counts as empty; texts under LENGTH bytes lose nothing; rows
with one doc_id and different texts are documents in order of xxhash64 of the text, rows
that repeat both are one document and get the same result each; a null doc_id comes first;
an empty table gives an empty result; further columns are ignored. `deduplicated` returns
the remaining bytes too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import bitmap_of, drop_written, let_through, release_shuffles, small_batches, table, text_or_empty, written

LENGTH = 100
ANCHOR = 32
#: Bytes that are looked at together; longer texts are taken in overlapping slices.
SLICE = 1 << 20
#: Starts of windows, counted from the anchor, that share a core. Cores cover the anchor: LENGTH - CELL + 1 is at least ANCHOR.
CELL = 23
#: Spans of a chunk, and shards whose transforms are merged.
CHUNK_SPANS = 4096
SHARDS = 4
#: Spans of an anchor over which they are dealt to several tasks.
HOT_SPANS = 2000
#: Bits of a window's place in the number that picks its anchor; the others are hash.
_HIGH = np.uint64((1 << 64) - (1 << 27))
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 15)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Texts of LENGTH bytes at least, or slices of them, about `most` bytes at a time: which text each is of, how far into it and into the joined bytes it starts (and their end), the bytes."""
    of, at, starts, parts, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass")
        for first in range(0, max(0, len(data) - LENGTH + 1), most):
            part = data[first : first + most + LENGTH - 1]
            of.append(i)
            at.append(first)
            starts.append(size)
            parts.append(part)
            size += len(part)
            if size >= most:
                yield np.array(of), np.array(at), np.array([*starts, size]), b"".join(parts)
                of, at, starts, parts, size = [], [], [], [], 0
    if parts:
        yield np.array(of), np.array(at), np.array([*starts, size]), b"".join(parts)


def runs(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(slice, anchor, start in data, length of span, place of the anchor in it) of each run of windows, in order; no window crosses the ends of a slice."""
    x = np.frombuffer(data, np.uint8)
    power, inverse = _power(len(x) + 1)
    grams, n = len(x) - ANCHOR + 1, len(x) - LENGTH + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[x] * power[: len(x)])])
    hashes = (sums[ANCHOR:] - sums[:grams]) * inverse[:grams]
    least = (hashes * _SPREAD & _HIGH) | np.arange(grams, dtype=np.uint64)
    width, have = LENGTH - ANCHOR + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least[:n] & ~_HIGH).astype(np.int64)
    whole = np.ones(n + 1, bool)
    for e in starts[1:-1].tolist():
        whole[max(0, e - LENGTH + 1) : e] = False
    whole[n] = False
    change = np.r_[True, place[1:] != place[:-1], True] | np.r_[True, whole[1:] != whole[:-1]]
    cut = np.flatnonzero(change)
    a, end = cut[:-1], cut[1:]
    keep = whole[a]
    a, end = a[keep], end[keep] + LENGTH - 1
    return np.searchsorted(starts, a, "right") - 1, _mix(hashes[place[a]]), a, end - a, place[a] - a


def span_hashes(data: bytes, a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH3 of each span, as rows of two longs."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[x : x + n]) for x, n in zip(a.tolist(), size.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def transform(strings: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of a collection, and where in the joined strings (an end, symbol 0, after each) its rows are. Rows are in order of their first `depth` symbols at least."""
    x = np.concatenate([y for s in strings for y in (s, np.zeros(1, np.int64))])
    n, ends = len(x), np.flatnonzero(x == 0)
    # Ranks of the first 2 ** k symbols, doubled; an end is a symbol of its own, in order of the strings.
    rank = x + len(ends)
    rank[ends] = np.arange(len(ends))
    stop, h = ends[np.r_[0, np.cumsum(x[:-1] == 0)]], 1
    while h < depth + 1:
        later = np.arange(n) + h
        second = np.where(later <= stop, rank[np.minimum(later, n - 1)] + 1, 0)
        _, rank = np.unique(rank * (int(second.max()) + 1) + second, return_inverse=True)
        h *= 2
    rows = np.argsort(rank, kind="stable")
    return np.where(np.r_[True, x[:-1] == 0][rows], 0, x[rows - 1]), rows


def interleaved(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms of collections of strings; symbol 0 ends a string, and no two ends are equal.

    Returns the shard of each row in merged order, and its common prefix with the row
    before it, `rounds` standing for that many symbols or more.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    joined = np.concatenate(transforms)
    joined = joined.astype(np.uint16 if joined.max(initial=0) < 1 << 16 else np.int64)  # 16 bits are distributed, not compared
    parted = np.full(len(shard), rounds)
    parted[:1] = 0
    block = np.zeros(len(shard), np.int64)
    for h in range(rounds):
        # The symbols that come before the rows: each shard's in its own order, dealt as the vector says.
        symbols = np.empty_like(joined)
        symbols[np.argsort(shard, kind="stable")] = joined
        order = np.argsort(symbols, kind="stable")
        symbols, block, shard = symbols[order], block[order], shard[order]
        new = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1]) | (symbols[1:] == 0)
        parted[1:][new & (parted[1:] == rounds)] = h
        block = np.r_[0, np.cumsum(new)]
    return shard, parted


def repeats(strings: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each substring of `length` symbols that an earlier one, in order of strings and offsets, is equal to."""
    cut = max(1, -(-len(strings) // SHARDS))
    shards = [strings[i : i + cut] for i in range(0, len(strings), cut)]
    made = [transform(s, length) for s in shards]
    shard, prefix = interleaved([t for t, _ in made], length)
    of, offset = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    for k, (_, rows) in enumerate(made):
        begin = np.concatenate([[0], np.cumsum(sizes[k * cut : k * cut + len(shards[k])] + 1)])
        s = np.searchsorted(begin, rows, "right") - 1
        at = shard == k
        of[at], offset[at] = s + k * cut, rows - begin[s]
    heads = np.flatnonzero(prefix < length)
    place = of << 32 | offset
    later = (np.repeat(np.minimum.reduceat(place, heads), np.diff(np.r_[heads, len(place)])) != place) & (offset + length <= sizes[of])
    return of[later], offset[later]


def strings_of(data: bytes, base: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The strings of some spans, which span each is of and how far into it the first window starts. base: where spans start in data; place: of the anchor in a span."""
    x = np.frombuffer(data, np.uint8)
    spans, left, right, core, first = [], [], [], [], []
    cores: dict[tuple[int, bytes], int] = {}
    for c in range(-(-(LENGTH - ANCHOR + 1) // CELL)):
        near, far = c * CELL, c * CELL + CELL - 1
        a, b = np.maximum(0, place - far), np.minimum(size - LENGTH, place - near)  # first and last window of the cell
        at = np.flatnonzero(a <= b)
        low, high = (base + place)[at] - near, (base + place)[at] - far + LENGTH  # the core
        spans.append(at)
        first.append(a[at])
        left.append(np.stack([(base + a)[at], low]))
        right.append(np.stack([high, (base + b)[at] + LENGTH]))
        core.append(np.fromiter((cores.setdefault((c, data[i:j]), len(cores)) for i, j in zip(low.tolist(), high.tolist(), strict=True)), np.int64, len(at)))
    of, first, core = (np.concatenate(z) for z in (spans, first, core))
    (a, low), (high, end) = np.concatenate(left, axis=1), np.concatenate(right, axis=1)
    order = np.lexsort((first, of))
    of, first, core, a, low, high, end = (z[order] for z in (of, first, core, a, low, high, end))
    n, m = low - a, end - high
    total = n + 1 + m
    begin = np.concatenate([[0], np.cumsum(total)])
    j = np.arange(begin[-1]) - np.repeat(begin[:-1], total)
    before, mid = j < np.repeat(n, total), j == np.repeat(n, total)
    source = np.where(before, np.repeat(a, total) + j, np.repeat(high - n - 1, total) + j)
    flat = np.where(mid, np.repeat(core + 257, total), x[np.where(mid, 0, source)].astype(np.int64) + 1)
    return np.split(flat, begin[1:-1]), of, first


def resolve(spans: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans with windows that repeat: which, the first and the last of these windows. spans: in order, all windows of a span hold its anchor."""
    size = np.fromiter(map(len, spans), np.int64, len(spans))
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    strings, of, first = strings_of(b"".join(spans), base, size, place)
    s, offset = repeats(strings, CELL)
    span, at = of[s], first[s] + offset
    order = np.lexsort((at, span))
    return span[order], at[order], size


def _stretches(span: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, first window, last window) of repeated windows: those of a span all hold its anchor, so neighbours always meet and they cover one stretch."""
    if not len(span):
        return span, at, at
    head = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
    return span[head], at[head], at[np.r_[head[1:] - 1, len(at) - 1]]


MERGED = "g long, len long, w1 long, w2 long"


def _merged(spans: DataFrame) -> DataFrame:
    """MERGED for spans (key, hot, g, place, bytes) that come by key and in order of g: stretches that repeat (w1 and w2 null) and, for keys that go on elsewhere, the other windows with their hashes."""
    small_batches(spans.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        hot: list[bool] = []
        g: list[int] = []
        place: list[int] = []
        data: list[bytes] = []
        split = False

        def flush(n: int, crossing: bool) -> pa.RecordBatch:
            span, at, size = resolve(data[:n], np.array(place[:n], np.int64))
            where = np.array(g[:n], np.int64)
            s, a, b = _stretches(span, at)
            out = [where[s] + a, b - a + LENGTH, None, None]
            if crossing:
                known = set(zip(span.tolist(), at.tolist(), strict=True))
                rest = [(i, o) for i in range(n) for o in range(int(size[i]) - LENGTH + 1) if (i, o) not in known]
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i][o : o + LENGTH]) for i, o in rest), np.int64).reshape(-1, 2)
                none = pa.nulls(len(s), pa.int64())
                out = [np.r_[out[0], np.array([g[i] + o for i, o in rest], np.int64)], np.r_[out[1], np.full(len(rest), LENGTH)], *(pa.concat_arrays([none, pa.array(h[:, k].copy())]) for k in (0, 1))]
            else:
                out[2:] = [pa.nulls(len(s), pa.int64())] * 2
            for c in (keys, hot, g, place, data):
                del c[:n]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in out], names=["g", "len", "w1", "w2"])

        def next_chunk(done: bool) -> tuple[int, bool, bool] | None:
            """Spans of the next chunk, whether its windows have to be compared with those of others, and whether its key goes on."""
            n = len(keys)
            if not n or (not done and n <= CHUNK_SPANS):
                return None
            if hot[0]:
                end = next((i for i in range(n) if not hot[i]), n)
                return min(end, CHUNK_SPANS), True, False
            if split:  # the rest of a key that was cut
                end = next((i for i in range(n) if keys[i] != keys[0]), n)
                return min(end, CHUNK_SPANS), True, end > CHUNK_SPANS or (end == n and not done)
            end = next((i for i in range(n) if hot[i]), n)
            if end <= CHUNK_SPANS and (done or end < n):
                return end, False, False
            cut = CHUNK_SPANS
            while cut and keys[cut - 1] == keys[cut]:
                cut -= 1
            return (cut, False, False) if cut else (CHUNK_SPANS, True, True)

        for batch in batches:
            for c, col in zip((keys, hot, g, place, data), batch.columns, strict=True):
                c += col.to_pylist()
            while found := next_chunk(False):
                n, crossing, split = found
                yield flush(n, crossing)
        while found := next_chunk(True):
            n, crossing, split = found
            yield flush(n, crossing)

    return spans.mapInArrow(run, MERGED)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """num (in order), doc_id, th, copies and text of each distinct document, and how many bits of a place are for the bytes."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.repartitionByRange(n, "doc_id", "th").groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    placed = written(ranged.sortWithinPartitions("doc_id", "th").withColumn("at", F.monotonically_increasing_id()), "placed")
    part, row = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = sorted(placed.groupBy(part.alias("p")).agg(F.max(row).alias("last"), F.max(F.octet_length("text")).alias("longest")).collect())  # a row a partition
    bits, base, before = max((r.longest for r in parts), default=0).bit_length(), {}, 0
    for r in parts:
        base[r.p] = before
        before += r.last + 1
    if before << bits >= 1 << 63:
        raise ValueError("documents times bytes of the longest one exceed 2 ** 63")
    bases = spark.createDataFrame(list(base.items()), "p long, base long")
    return placed.join(F.broadcast(bases), part == F.col("p")).select((F.col("base") + row).alias("num"), "doc_id", "th", "copies", "text"), bits


def _mapped(docs: DataFrame, run, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows of `schema` that run makes of a batch: numbers of documents (array) and their texts."""
    small_batches(docs.sparkSession)
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for cols in run(b.column(0).to_numpy(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return docs.select("num", "text").mapInArrow(batches, schema)


def intervals(docs: DataFrame, bits: int) -> DataFrame:
    """g and len of stretches that together cover all repeated bytes; docs: num, text."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast

    def count(num: np.ndarray, texts: list[str]) -> Iterator[tuple]:
        found = [runs(data, starts)[1] for _, _, starts, data in slices(texts)]
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        yield h.view(np.int64), n

    counts = _mapped(docs, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = send(bitmap_of(counts, "key"))
    release_shuffles(spark)

    def kept(num: np.ndarray, texts: list[str]) -> Iterator[tuple]:
        """(bytes, starts of spans, key, g, length, place, hashes) of runs whose anchor may repeat."""
        for of, at, starts, data in slices(texts):
            k, key, a, size, place = runs(data, starts)
            keep = np.flatnonzero(let_through(repeated.value, key))
            k, key, a, size, place = (c[keep] for c in (k, key, a, size, place))
            g = (num[of[k]] << bits) + at[k] + a - starts[k]
            yield data, a, key.view(np.int64), g, size, place, span_hashes(data, a, size)

    def listed(num: np.ndarray, texts: list[str]) -> Iterator[tuple]:
        for _, _, key, g, size, _, h in kept(num, texts):
            yield key, g, size.astype(np.int32), h[:, 0].copy(), h[:, 1].copy()

    found = written(_mapped(docs, listed, "key long, g long, len int, s1 long, s2 long"), "runs")
    groups = written(found.groupBy("s1", "s2").agg(F.min("g").alias("f"), F.min("len").alias("len"), F.min("key").alias("key"), F.count("*").alias("n")), "firsts")
    copies = written(found.join(groups.where("n > 1").select("s1", "s2", "f"), ["s1", "s2"]).where("g <> f").select("g", F.col("len").cast("long").alias("len")), "copies")
    drop_written(found)
    shared = written(groups.groupBy("key").agg(F.count("*").alias("n_spans")).where("n_spans > 1"), "shared")  # a table: a hot key's rows can be split in the join
    opened = written(groups.select("key", "s1", F.col("f").alias("g")).join(shared, "key"), "contested")
    drop_written(groups, shared)
    wanted = send(bitmap_of(opened.select(F.col("s1").bitwiseXOR(F.col("g")).alias("h")), "h"))

    def cut(num: np.ndarray, texts: list[str]) -> Iterator[tuple]:
        for data, a, _, g, size, place, h in kept(num, texts):
            keep = np.flatnonzero(let_through(wanted.value, (h[:, 0] ^ g).view(np.uint64)))
            yield g[keep], place[keep].astype(np.int32), pa.array([data[x : x + n] for x, n in zip(a[keep].tolist(), size[keep].tolist(), strict=True)], pa.binary())

    pieces = _mapped(docs, cut, "g long, place int, bytes binary").join(opened.select("g", "key", "n_spans"), "g")
    hot = F.col("n_spans") > HOT_SPANS
    salt = F.when(hot, F.pmod(F.xxhash64("g"), F.ceil(F.col("n_spans") / HOT_SPANS))).otherwise(F.lit(0))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("key", hot.alias("hot"), salt.alias("salt"), "g", "place", "bytes").repartition(n, "key", "salt").sortWithinPartitions("hot", "key", "g").drop("salt")  # salts that meet in a task stay in order of documents
    merged = written(_merged(dealt), "merged")
    drop_written(opened)
    windows = merged.where("w1 IS NOT NULL")
    firsts = windows.groupBy("w1", "w2").agg(F.min("g").alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, ["w1", "w2"]).where("g > f").select("g", "len")
    return copies.union(merged.where("w1 IS NULL").select("g", "len")).union(later)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row."""
    placed, bits = numbered(docs)
    found = intervals(placed, bits)
    start = F.col("g").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    gone = found.groupBy(F.shiftrightunsigned("g", bits).alias("of")).agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("len")).alias("end"))).alias("gone"))
    gone = written(gone, "intervals")
    joined = placed.join(gone, F.col("num") == F.col("of"), "left").select("doc_id", "text", "gone", "copies")
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_without(t.encode("utf-8", "surrogatepass"), x or []) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            out = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(np.repeat(np.arange(len(rows)), b.column(3).to_numpy()))) for c in out], names=[f.name for f in schema])

    return joined.mapInArrow(run, schema)


def _without(data: bytes, gone: list[dict]) -> tuple[int, int, int, str, bytes]:
    kept, last, spans, removed = [], 0, 0, 0
    reach = -1
    for x in sorted((g["start"], g["end"]) for g in gone):
        if x[0] > reach:
            kept.append(data[last : x[0]])
            spans += 1
            removed += x[1] - x[0]
            reach = x[1]
        elif x[1] > reach:
            removed += x[1] - reach
            reach = x[1]
        last = reach
    kept.append(data[max(last, 0) :])
    out = b"".join(kept)
    return len(data), removed, spans, hashlib.sha256(out).hexdigest(), out


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
