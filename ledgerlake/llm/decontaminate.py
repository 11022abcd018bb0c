r"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document if at least THRESHOLD of its distinct shingles (SHINGLE
words, lower case, `\w+`) are in it, wherever in the document, however long that is.

Items are partitioned by their number of shingles. A partition with at most u shingles an
item keeps the k = u - ceil(t * u) + 1 least hash values of each item as its MinHash
sketch. An item that is contained at threshold t lacks at most n - ceil(t * n) < k of its
shingles, so one value of the sketch at least is among the document's shingles: the
search misses nothing, and short items need few values. Documents are not sketched; all
their shingles are looked up, so length does not dilute them as it would in a Jaccard
estimate. Candidates are verified on the shingles themselves, not on hashes.

Sketches of about BLOCK_BYTES of items at a time are made and broadcast, so their size is
bounded on the driver too; a larger benchmark takes more passes over the documents, each
written before the next block is read.

Defined cases: null texts count as empty; items without a word are in no document; items
shorter than a shingle ("yes") say too little to be sought in texts: they are found where
they are all that a document says; a repeated row of documents
gets its matches as often as it comes, items that repeat a text match each under its id;
a null item_id or doc_id is kept as it is; empty tables give an empty result; further
columns are ignored, and `clean_rows` returns those of documents untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import flat_map_texts, keep_rows, table, word_hashes, written

SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of benchmark texts whose sketches are broadcast at once, about.
BLOCK_BYTES = 16_000_000
WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_FILTER_BITS = 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j : j + n] * _ODD[j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))


class Sketches:
    """The searchable form of some items. Small enough to send to each task."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float = THRESHOLD, shingle: int = SHINGLE) -> None:
        self.threshold = threshold
        self.items: list[tuple[object, int, frozenset[tuple[str, ...]]]] = []
        self.shingle, self.short = shingle, {}
        entries: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text or "")
            if not words:
                continue
            if len(words) < shingle:
                self.short.setdefault(tuple(words), []).append(len(self.items))
                self.items.append((item_id, len(words), frozenset([tuple(words)])))
                continue
            size = shingle
            grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
            values = dict(zip(grams, _rolled(_word_hashes(words), size).tolist(), strict=True))
            n = len(values)
            u = 1 << (n - 1).bit_length()  # the partition's largest size
            k = min(n, u - self.needed(u) + 1)
            for v in sorted(set(values.values()))[:k]:
                entries.setdefault(size, []).append((v, len(self.items)))
            self.items.append((item_id, size, frozenset(values)))
        self.lookup: dict[int, tuple[np.ndarray, list[list[int]], np.ndarray]] = {}
        for size, pairs in entries.items():
            by: dict[int, list[int]] = {}
            for v, i in pairs:
                by.setdefault(v, []).append(i)
            keys = np.array(sorted(by), np.uint64)
            sieve = np.zeros(1 << _FILTER_BITS, bool)
            sieve[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.lookup[size] = (keys, [by[int(v)] for v in keys], sieve)

    def needed(self, n: int) -> int:
        return max(1, ceil(self.threshold * n - 1e-9))

    def find(self, text: str) -> list[tuple[int, int]]:
        """(place of the item, shingles shared) of each item that the text contains."""
        words = words_of(text)
        if len(words) < self.shingle:
            return [(i, 1) for i in self.short.get(tuple(words), [])]
        h, out = _word_hashes(words), []
        for size, (keys, of, sieve) in self.lookup.items():
            values = _rolled(h, size)
            values = values[sieve[(values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]]
            if not len(values):
                continue
            at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            hits = np.unique(at[keys[at] == values])
            candidates = sorted({i for k in hits.tolist() for i in of[k]})
            if candidates:
                grams = set(zip(*(words[j:] for j in range(size)), strict=False))
                for i in candidates:
                    shared = len(self.items[i][2] & grams)
                    if shared >= self.needed(len(self.items[i][2])):
                        out.append((i, shared))
        return out


def blocks(benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> tuple[int, Iterator[Sketches]]:
    """How many blocks of items there are, and each in turn: none is read before the last one has been used."""
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = -(-int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, (Sketches([(r[0], r[1]) for r in rows.where(part == i).collect()], threshold, shingle) for i in range(n))


def _passes(docs: DataFrame, n: int, sketches: Iterator[Sketches], over: Callable[[Broadcast], DataFrame], name: str) -> Iterator[DataFrame]:
    """What `over` makes of each block. One block: as a plan; more: written, so that each broadcast is gone before the next."""
    for sketch in sketches:
        sent = docs.sparkSession.sparkContext.broadcast(sketch)
        del sketch
        if n == 1:
            yield over(sent)
        else:
            out = written(over(sent), name)
            sent.destroy()
            yield out


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles and containment of each item found in a document."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def over(sent: Broadcast) -> DataFrame:
        def run(texts: list[str]) -> tuple[list[int], dict[str, list]]:
            s = sent.value
            rows = [(at, *s.items[i][::2], shared) for at, text in enumerate(texts) for i, shared in s.find(text)]
            return [r[0] for r in rows], {"item_id": [r[1] for r in rows], "n_shared": [r[3] for r in rows], "n_shingles": [len(r[2]) for r in rows], "containment": [r[3] / len(r[2]) for r in rows]}

        return flat_map_texts(docs, ["doc_id"], "text", run, f"item_id {kind}, n_shared long, n_shingles long, containment double")

    return reduce(DataFrame.union, _passes(docs, *blocks(benchmark, threshold, shingle), over, "matches"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    left = docs
    for left in _passes(docs, *blocks(benchmark, threshold, shingle), lambda sent: keep_rows(left, "text", lambda texts: [not sent.value.find(t) for t in texts]), "clean"):
        pass
    return left


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
