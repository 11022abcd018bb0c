"""Token ids in a content-addressed store.

Each text becomes ids of a public tokenizer, with END after them. A rolling hash over the
last WINDOW ids cuts the stream of a document into chunks (mean MEAN_IDS, at most
MOST_IDS), so equal passages make equal chunks wherever they stand. A store is a folder
of Parquet tables:

* chunks: id (SHA-256 of the bytes), n ids, data (ids as little-endian unsigned 16-bit
  numbers, 32-bit ones where the vocabulary is larger). Each unique chunk is stored once.
* recipes, in ascending order of the documents: part, at, the order columns, n_tokens,
  chunks (the ids of the document's chunks in order).
* manifest: a row a part of the recipes: rows, tokens, and the Merkle root over its
  recipes, whose leaves name the chunks by content.

`verify` reads all three back: every chunk must hash to its id, every recipe must name
stored chunks of its length, every root must come out again. `read_documents` puts the
ids of documents together; `digests` gets the CRC-32 of each whole document from those of
its chunks by combining them, so no ids are shuffled.

Speed. Byte-level BPE treats the pieces of a text that its pattern cuts on their own. A
bounded cache keeps the ids of pieces that the tokenizers library has encoded. Texts with
characters beyond those for which both Unicode tables surely agree, and all texts where
the tokenizer's own settings are others (a normaliser, a prefix space, another pattern,
added tokens that are not special), go to the library whole. The strings of special tokens
in a text are ordinary text.

Defined cases: a null text counts as empty and has only END; a null doc_id comes first;
rows with the same order values are put in order of their chunks; a repeated row has its
own recipe and shares its chunks; an empty table makes an empty store; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.llm.common import flat_map_texts, new_path, small_batches, table

END = 2
WINDOW = 8
MEAN_IDS = 512
MOST_IDS = 4096
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The pieces that byte-level BPE cuts a text into, for the characters that are not UNSURE.
PIECES = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
#: Anything but printable ASCII, Latin letters, common marks and usual white space; numbers that are no digits too.
UNSURE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ–—‘’“”…]|[²³¹¼-¾]")
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids as bytes. Made once a worker and kept: see encoder()."""

    MOST = 400_000
    #: Texts, and characters of them, that go to the library at once: its results are many times as large.
    TEXTS, CHARS = 4096, 200_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_pieces = cuts_as_usual(json.loads(self.tokenizer.to_str()))
        self.line_end = self.tokenizer.token_to_id("\u010a")  # of byte-level BPE
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([END], self.kind).tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        of, out, first, chars = "H" if self.kind.itemsize == 2 else "I", [], 0, 0
        for i, t in enumerate(texts, 1):
            chars += len(t)
            if chars >= self.CHARS or i - first >= self.TEXTS or i == len(texts):
                out += [array(of, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[first:i], add_special_tokens=False)]
                first, chars = i, 0
        return out

    def learn(self, pieces: set[str]) -> None:
        """Keeps the ids of pieces, None for those with UNSURE characters. Pieces go to the library in lines, as a line end is a piece of its own there; single calls cost more."""
        if UNSURE.search("".join(pieces)):
            unsure = {p for p in pieces if UNSURE.search(p)}
            self.young.update(dict.fromkeys(unsure))
            pieces = pieces - unsure
        lines, alone = [], []
        for p in pieces:
            (alone if self.line_end is None or p.isspace() else lines).append(p)
        for first in range(0, len(lines), self.TEXTS):
            some = lines[first : first + self.TEXTS]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.line_end).tolist()
            if len(ends) != len(some) - 1:
                raise ValueError("the tokenizer joins a line end with what is beside it")
            raw, k = ids.tobytes(), self.kind.itemsize
            self.young.update(zip(some, [raw[a * k : b * k] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)], strict=True))
        self.young.update(zip(alone, self.library(alone), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, END after them."""
        if not self.by_pieces:
            return [raw + self.end for raw in self.library(texts)]
        pieces = list(map(PIECES.findall, texts))
        known, old = self.young, self.old
        missing = set().union(*pieces).difference(known)
        if old:
            again = missing & old.keys()
            known.update((p, old[p]) for p in again)
            missing -= again
        self.learn(missing)
        out: list[bytes | None] = []
        for ps in pieces:
            try:
                out.append(b"".join(map(known.__getitem__, ps)) + self.end)
            except TypeError:  # an unsure piece
                out.append(None)
        whole = [i for i, raw in enumerate(out) if raw is None]
        for i, raw in zip(whole, self.library([texts[i] for i in whole]), strict=True):
            out[i] = raw + self.end
        if len(known) > self.MOST:
            self.young, self.old = {}, known
        return out


def cuts_as_usual(settings: dict) -> bool:
    """Whether a tokenizer's settings are those for which PIECES may be encoded on their own."""
    before = settings.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return bool(plain and (settings.get("model") or {}).get("type") == "BPE" and not settings.get("normalizer") and all(t.get("special") for t in settings.get("added_tokens") or []))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def cuts(ids: np.ndarray, lengths: list[int] | None = None) -> list[list[int]]:
    """The ends of the chunks of each document, as places in it. ids: those of all documents, one after another, of the given lengths."""
    lengths = [len(ids)] if lengths is None else lengths
    n = len(ids)
    x = ids.astype(np.uint64)
    stops = np.cumsum(lengths, dtype=np.int64) if lengths else np.zeros(0, np.int64)
    h = x * _ODD[0]
    for j in range(1, min(WINDOW, n)):
        h[j:] += x[: n - j] * _ODD[j]
    # Over all documents at once; then the first ids of each, which see none of the document before.
    first, size = stops - np.array(lengths, np.int64), np.minimum(lengths, WINDOW - 1).astype(np.int64)
    head = np.repeat(first, size)
    since = np.arange(len(head)) - np.repeat(np.cumsum(size) - size, size)
    at = head + since
    h[at] = x[at] * _ODD[0]
    for j in range(1, WINDOW - 1):
        h[at[since >= j]] += x[at[since >= j] - j] * _ODD[j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN_IDS) == 0) + 1
    of = np.searchsorted(at, stops, "right").tolist()
    at, out, k = at.tolist(), [], 0
    for stop, size, upto in zip(stops.tolist(), lengths, of, strict=True):
        ends, last, start = [], 0, stop - size
        for e in [*at[k:upto], stop]:
            while e - start - last > MOST_IDS:
                last += MOST_IDS
                ends.append(last)
            if e - start > last:
                ends.append(last := e - start)
        k = upto
        out.append(ends)
    return out


def encoded(docs: DataFrame, order: list[str], path: str) -> DataFrame:
    """Rows of two kinds: a chunk (kind 0, key its id, n, data) for each first sight in a batch, and a recipe (kind 1) for each document."""

    def run(texts: list[str]) -> tuple[list[int], dict[str, list]]:
        e = encoder(path)
        seen: set[bytes] = set()
        rows: list[tuple] = []
        raws, k = e.encode(texts), e.kind.itemsize
        for at, (raw, ends) in enumerate(zip(raws, cuts(np.frombuffer(b"".join(raws), e.kind), [len(r) // k for r in raws]), strict=True)):
            last, names = 0, []
            for end in ends:
                data = raw[last * k : end * k]
                name = hashlib.sha256(data).digest()
                names.append(name)
                if name not in seen:
                    seen.add(name)
                    rows.append((at, 0, name, end - last, data, None))
                last = end
            rows.append((at, 1, b"", len(raw) // k, None, names))
        return [r[0] for r in rows], {"kind": [r[1] for r in rows], "id": [r[2] for r in rows], "n": [r[3] for r in rows], "data": [r[4] for r in rows], "chunks": [r[5] for r in rows]}

    return flat_map_texts(docs, order, "text", run, "kind int, id binary, n long, data binary, chunks array<binary>")


def _leaf(names: list[bytes], n: int) -> bytes:
    return hashlib.sha256(b"\0" + n.to_bytes(8, "little") + b"".join(names)).digest()


class Merkle:
    """The root over leaves that come one by one, with a node a level in memory."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        size = 1
        while self.levels and self.levels[-1][0] == size:
            leaf = hashlib.sha256(b"\1" + self.levels.pop()[1] + leaf).digest()
            size *= 2
        self.levels.append((size, leaf))

    def root(self) -> bytes:
        out = b""
        for _, x in reversed(self.levels):
            out = hashlib.sha256(b"\1" + x + out).digest() if out else x
        return out or hashlib.sha256(b"").digest()


def _roots(recipes: DataFrame) -> DataFrame:
    """part, n_rows, n_tokens and root of each part. A part is one file, read in its order by one task or several in turn."""
    small_batches(recipes.sparkSession)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows, tokens, part = Merkle(), 0, 0, None
        for b in source:
            for p, n, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([rows], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()], pa.binary())], names=["part", "n_rows", "n_tokens", "root"])
                    tree, rows, tokens, part = Merkle(), 0, 0, p
                tree.add(_leaf(names, n))
                rows += 1
                tokens += n
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([rows], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()], pa.binary())], names=["part", "n_rows", "n_tokens", "root"])

    return recipes.select("part", "n_tokens", "chunks").mapInArrow(batches, "part long, n_rows long, n_tokens long, root binary")


def write_store(docs: DataFrame, path: str, order: list[str] | None = None, tokenizer: str | None = None) -> None:
    """Writes the store of docs (order columns, text) under `path`. order: the columns that order documents, doc_id alone by default."""
    spark, order = docs.sparkSession, order or ["doc_id"]
    rows = encoded(docs, order, tokenizer or tokenizer_path())
    # One shuffle: a chunk that several tasks have seen stays once; a recipe has a number of its own, the same if its task runs again.
    own = F.when(F.col("kind") == 1, F.monotonically_increasing_id()).otherwise(-1)
    rows.withColumn("own", own).dropDuplicates(["kind", "id", "own"]).drop("own").write.option("compression", "snappy").partitionBy("kind").parquet(f"{path}/raw")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = spark.read.schema(rows.schema).parquet(f"{path}/raw").where("kind = 1").select(*order, F.col("n").alias("n_tokens"), "chunks")
    by = [*order, "chunks"]
    at = F.monotonically_increasing_id()
    ranged = raw.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", at)
    ranged.select(F.shiftrightunsigned("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), *order, "n_tokens", "chunks").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _ordered_roots(read_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _ordered_roots(recipes: DataFrame) -> DataFrame:
    """Merkle roots, whatever files the reader put together or cut: rows of a part meet in one task, in order."""
    return _roots(recipes.repartition("part").sortWithinPartitions("part", "at"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id binary, n long, data binary, kind int").parquet(f"{path}/raw").where("kind = 0").select("id", "n", "data")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


_ZEROS = memoryview(bytes(4 * MOST_IDS))


@lru_cache(maxsize=1 << 14)
def _zeros_sum(n: int) -> int:
    return zlib.crc32(_ZEROS[:n])


def combined(parts: Iterable[tuple[int, int]]) -> int:
    """The CRC-32 of byte strings one after another, from (CRC-32, length) of each: a CRC goes on over zeros as over any bytes, and their own CRC is taken out."""
    out = 0
    for crc, n in parts:
        while n > len(_ZEROS):
            out = zlib.crc32(_ZEROS, out) ^ _zeros_sum(len(_ZEROS))
            n -= len(_ZEROS)
        out = zlib.crc32(_ZEROS[:n], out) ^ _zeros_sum(n) ^ crc
    return out


def _chunk_sums(chunks: DataFrame) -> DataFrame:
    """id, n and crc (of the ids as little-endian unsigned 32-bit numbers) of each chunk as read from the store; fails on a chunk that is not what its id says."""
    small_batches(chunks.sparkSession)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            crcs = []
            for name, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                width = len(data) // n
                if hashlib.sha256(data).digest() != name or width * n != len(data):
                    raise ValueError(f"chunk {name.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64())], names=["id", "n", "crc"])

    return chunks.mapInArrow(batches, "id binary, n long, crc long")


def digests(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """Of each document, read back: the order columns, start (ids of all before it), n_tokens, ids_crc32 (of all its ids as little-endian unsigned 32-bit numbers)."""
    order = order or ["doc_id"]
    recipes, sums = read_recipes(spark, path), _chunk_sums(read_chunks(spark, path))
    refs = recipes.select("part", "at", F.posexplode("chunks").alias("k", "id"))
    found = refs.join(sums, "id", "left").groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("k", "n", "crc"))).alias("sums"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            parts = b.column(2).flatten()
            if parts.field("crc").null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            crc, n, at, lengths, crcs = parts.field("crc").to_pylist(), parts.field("n").to_pylist(), 0, [], []
            for k in b.column(2).value_lengths().to_pylist():
                lengths.append(sum(n[at : at + k]))
                crcs.append(combined(zip(crc[at : at + k], (4 * x for x in n[at : at + k]), strict=True)))
                at += k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "at", "n_read", "ids_crc32"])

    got = found.mapInArrow(batches, "part long, at long, n_read long, ids_crc32 long")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over the manifest: a row a part
    offsets = spark.read.parquet(f"{path}/manifest").select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    earlier = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = recipes.drop("chunks").join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    joined = placed.join(got, ["part", "at"])
    exact = F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe's length differs from its chunks")))
    return joined.select(*order, "start", exact.cast("long").alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str, order: list[str] | None = None) -> DataFrame:
    """The order columns and `data` (the bytes of all ids, put together from chunks) of each document."""
    recipes = read_recipes(spark, path)
    refs = recipes.select("part", "at", F.posexplode("chunks").alias("k", "id")).join(read_chunks(spark, path), "id")
    data = refs.groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("k", "data"))).alias("pieces"))
    whole = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["data"]))
    return recipes.join(data, ["part", "at"]).select(*(order or ["doc_id"]), whole.alias("data"))


def verify(spark: SparkSession, path: str) -> None:
    """Raises ValueError if a Merkle root of the manifest does not come out of the recipes again; digests() checks the chunks."""
    a, b = spark.read.parquet(f"{path}/manifest"), _ordered_roots(read_recipes(spark, path))
    wrong = a.join(b.withColumnRenamed("root", "again"), "part", "full").where("root IS DISTINCT FROM again").count()
    if wrong:
        raise ValueError(f"{wrong} parts of the recipes are damaged")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path)
    verify(spark, path)
    return digests(spark, path)
