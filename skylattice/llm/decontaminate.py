"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles.

Windows have as many words as the item. Two multisets of the same size are 0.8 alike only if they share 8/9 of
their shingles, so windows with fewer shingles of the benchmark than that are passed over unseen. The others
are fingerprinted; an index of fingerprint blocks gives all items of that length within the radius; weighted
Jaccard on the full multisets decides. A document with fewer words than the item is its own only window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 about 10 of 64 bits differ, with a deviation of 3.
RADIUS = 23
#: Blocks of the 64 bits; by the pigeonhole principle one block of any fingerprint within RADIUS differs in
#: at most RADIUS // BLOCKS bits.
BLOCKS = 12
#: Items, and bytes of their texts, broadcast at a time, about; a larger benchmark is searched in several passes.
ITEMS_PER_PASS = 100_000
BYTES_PER_PASS = 64 << 20
#: Bits of a shingle's hash that the first look at it takes.
GLANCE = 22
#: Words whose windows are fingerprinted at a time; a bound on memory, not on windows.
WINDOWS = 4096
_EDGE = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the n-word shingles; a shorter sequence is one shingle, none if it is empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return arrays.kgrams(words, min(n, len(words)))


def simhashes(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of each window of ``size`` shingles, each shingle weighted by its count: from running sums of the bits."""
    first, last = int(starts[0]), int(starts[-1]) + size
    bits = np.unpackbits(arrays.mix(grams[first:last]).view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[starts - first + size] - total[starts - first]
    return np.packbits(2 * ones > size, axis=1).view(np.uint64).ravel()


def weighted(a: Counter, b: Counter) -> float:
    """Sum of minima over sum of maxima of the counts."""
    inter = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return inter / (a.total() + b.total() - inter)


class HammingIndex:
    """Fingerprints by the value of each block; ``within`` finds all of them within the radius."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        # per block and value, which fingerprints have a block as near as the pigeonhole principle asks for
        self.near = []
        for b in range(BLOCKS):
            value = np.arange(1 << _EDGE[b + 1] - _EDGE[b], dtype=np.uint64)
            self.near.append(np.bitwise_count(value[:, None] ^ self._part(prints, b)[None, :]) <= RADIUS // BLOCKS)

    @staticmethod
    def _part(p: np.ndarray, b: int) -> np.ndarray:
        return p >> np.uint64(_EDGE[b]) & np.uint64((1 << _EDGE[b + 1] - _EDGE[b]) - 1)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``prints``, which fingerprint) of all pairs within the radius."""
        met = np.zeros((len(prints), len(self.prints)), bool)
        for b, near in enumerate(self.near):
            met |= near[self._part(prints, b).astype(np.int64)]
        i, j = np.nonzero(met)
        ok = np.bitwise_count(prints[i] ^ self.prints[j]) <= RADIUS
        return i[ok], j[ok]


class Benchmark:
    """Items of one pass, ready for search."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        of: dict[int, list[int]] = {}
        self.grams: list[Counter] = []
        prints, every = [], []
        for n, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = arrays.Words(raw, np.array([0, len(raw)]))
            g = shingles(words.hashes(lower=True))
            self.grams.append(Counter(g.tolist()))
            prints.append(simhashes(g, np.zeros(1, np.int64), len(g))[0] if len(g) else np.uint64(0))
            every.append(g)
            if len(words):
                of.setdefault(len(words), []).append(n)
        self.lengths = sorted(of)
        self.n_words = {i: n for n, rows in of.items() for i in rows}
        self.items = of
        self.index = {n: HammingIndex(np.array([prints[i] for i in rows], np.uint64)) for n, rows in of.items()}
        # by shingle width: shingles of that many words that occur in items (short items have their own width)
        self.known = {}
        for n in self.lengths:
            w = min(n, SHINGLE)
            self.known.setdefault(w, []).extend(every[i] for i in of[n])
        self.known = {w: np.unique(np.concatenate(g)) for w, g in self.known.items()}
        self.glance = {w: np.zeros(1 << GLANCE, bool) for w in self.known}
        for w, g in self.known.items():
            self.glance[w][g >> np.uint64(64 - GLANCE)] = True

    def holding(self, words: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which documents of a slice, given by word hashes, hold a shingle of the benchmark; no other has to be searched."""
        held = np.zeros(len(off) - 1, bool)
        for w in self.known:
            g = arrays.kgrams(words, w)
            place = np.flatnonzero(self.glance[w][g >> np.uint64(64 - GLANCE)])
            at = np.minimum(np.searchsorted(self.known[w], g[place]), len(self.known[w]) - 1)
            place = place[self.known[w][at] == g[place]]
            doc = np.searchsorted(off, place, "right") - 1
            held[doc[place + w <= off[doc + 1]]] = True
        return np.flatnonzero(held)

    def search(self, words: np.ndarray) -> dict[int, tuple[float, int]]:
        """Best (similarity, first word) per item number of one document given by its word hashes."""
        found: dict[int, tuple[float, int]] = {}
        grams = {w: arrays.kgrams(words, w) for w in self.known if len(words) >= w}
        hits = {}
        for w, g in grams.items():
            at = np.minimum(np.searchsorted(self.known[w], g), len(self.known[w]) - 1)
            hit = self.known[w][at] == g
            if hit.any():
                hits[w] = np.concatenate([[0], np.cumsum(hit)])
        for n in self.lengths:
            w = min(n, SHINGLE)
            if w not in hits:
                continue
            whole = n - w + 1
            size = min(whole, len(words) - w + 1)
            inside = hits[w][size:] - hits[w][:-size]
            starts = np.flatnonzero(inside * (1 + SIMILARITY) >= SIMILARITY * (whole + size) - 1e-9)
            at = np.searchsorted(starts, np.arange(0, len(words) + WINDOWS, WINDOWS))
            for part in (starts[a:b] for a, b in zip(at[:-1], at[1:]) if a < b):
                last, own = -1, None
                for i, j in zip(*(x.tolist() for x in self.index[n].within(simhashes(grams[w], part, size)))):
                    start, item = int(part[i]), self.items[n][j]
                    if start != last:
                        last, own = start, Counter(grams[w][start : start + size].tolist())
                    s = weighted(own, self.grams[item])
                    if s >= SIMILARITY - 1e-12 and s > found.get(item, (0.0, 0))[0]:
                        found[item] = s, start
        return found


_prepared: list[tuple[list, Benchmark]] = []


def prepared(items: list[tuple[int, str]]) -> Benchmark:
    """The benchmark of these items; tasks of one worker process that share a pass build it once."""
    if not _prepared or _prepared[0][0] != items:
        _prepared[:] = [(items, Benchmark(items))]
    return _prepared[0][1]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item that a document holds, at its best window.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; similarity is weighted Jaccard of five-word shingles, 0.8
    or more (an item of fewer words is one shingle). A document shorter than the item is compared as a whole; ``n_words``
    are those of the window. Ties go to the first window. Null and empty texts or items
    match nothing; repeated rows give a row each; items of equal text are each reported, and an item row given twice twice.
    Other columns, whatever their names, play no part. Texts are searched whole. The corpus is not shuffled.
    """
    spark = docs.sparkSession
    items = common.stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("copies")))
    many, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-many // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))
    docs = common.documents(docs, id_col, text_col)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"

    def one(part: DataFrame) -> DataFrame:
        # different items are dealt evenly by hash: about ITEMS_PER_PASS of them
        told = part.orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([(r[0], r[1]) for r in told], [r[2] for r in told]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, copies = shared.value
            bench = prepared(items)
            for batch in batches:
                for lo, _, data, off in arrays.slices(batch.column(1)):
                    words = arrays.Words(data, off)
                    h = words.hashes(lower=True)
                    rows = []
                    for d in bench.holding(h, words.off).tolist():
                        n = int(words.counts[d])
                        for item, (s, start) in sorted(bench.search(h[words.off[d] : words.off[d + 1]]).items()):
                            rows += copies[item] * [(batch.column(0)[lo + d].as_py(), bench.ids[item], s, start, min(bench.n_words[item], n))]
                    if rows:
                        c = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return docs.mapInArrow(run, schema)

    found = None
    for p in range(passes):
        part = one(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p))
        found = part if found is None else found.union(part)
    return found


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of ``benchmark`` that a document holds: (doc_id, item_id, similarity, first_word, n_words)."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
