"""Language-model scores from a log-frequency Bloom filter.

A count is kept as its level, the number of thresholds that it reaches; these grow by half an octave. The
filter holds (n-gram, 1) .. (n-gram, level). A lookup probes level after level until one is missing. The filter is
made of blocks; an n-gram's bits are all in the block of its leading hash bits, so that each block is built by one
task from its own n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common

PROBES = 4
BITS_PER_ENTRY = 10
#: Text bytes per block of the filter, about 4 MB of n-grams.
BYTES_PER_BLOCK = 2 << 20
#: Text bytes whose equal n-grams are added up in a task before they are sent.
TALLY_BYTES = 4 << 20
#: Filter bytes broadcast at a time; a larger filter is used part by part, each with a pass over the documents.
BROADCAST_BYTES = 128 << 20
#: Words of the exact count table that are broadcast; the others are joined.
WIDESPREAD = 1 << 18
#: Weight of the pair's share against the word's own.
WEIGHT = 0.6
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)


def _thresholds() -> np.ndarray:
    """1, 2, 3, 5, 8, 12, ..: each the next whole number from 2**(1/2) times the one before, to the end of 64 bits."""
    out = [1]
    while out[-1] < 1 << 61:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 2**0.5)))
    return np.array(out, np.int64)


THRESHOLDS = _thresholds()


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered) of a slice, an end token after each document, and where each begins."""
    words = arrays.Words(data, off)
    h = words.hashes(lower=True)
    n = len(off) - 1
    out = np.empty(len(h) + n, np.uint64)
    at = words.off + np.arange(n + 1)
    out[at[1:] - 1] = END
    is_word = np.ones(len(out), bool)
    is_word[at[1:] - 1] = False
    out[is_word] = h
    return out, at


def bigrams(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a document follows the start mark."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[at[:-1]] = START
    return arrays.mix(before * arrays.BASE + tok)


def contexts(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[at[:-1]] = START
    return before


def unigram(words: np.ndarray) -> np.ndarray:
    return arrays.mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _places(grams: np.ndarray, level: int, bits: np.ndarray) -> list[np.ndarray]:
    x = arrays.mix(grams + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    y = arrays.mix(x) | np.uint64(1)
    return [(x + np.uint64(i) * y) % bits for i in range(PROBES)]


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, "right")


def build_block(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of one block."""
    level = level_of(counts)
    size = np.uint64(max(64, int(level.sum()) * BITS_PER_ENTRY + 7 & ~7))
    bits = np.zeros(int(size), bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in _places(grams[level >= j], j, size):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Some blocks of the filter laid end to end; ``levels`` gives 0 for n-grams of other blocks and for unseen ones."""

    def __init__(self, n_blocks: int, blocks: Iterable[tuple[int, bytes]]):
        self.size = np.zeros(n_blocks, np.uint64)
        self.first = np.zeros(n_blocks, np.int64)
        held = bytearray()
        for b, content in blocks:
            self.size[b], self.first[b] = len(content) * 8, len(held) * 8
            held += content
        self.data = np.frombuffer(held, np.uint8)
        self.n_blocks = n_blocks

    def levels(self, grams: np.ndarray) -> np.ndarray:
        block = block_of(grams, self.n_blocks)
        out = np.zeros(len(grams), np.int64)
        live = np.flatnonzero(self.size[block] > 0)
        for j in range(1, len(THRESHOLDS) + 1):
            if not len(live):
                break
            b = block[live]
            ok = np.ones(len(live), bool)
            for place in _places(grams[live], j, self.size[b]):
                p = place.astype(np.int64) + self.first[b]
                ok &= (self.data[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
            live = live[ok]
            out[live] = j
        return out


def block_of(grams: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)


def least(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 for none."""
    return np.where(level > 0, THRESHOLDS[np.maximum(level, 1) - 1], 0).astype(np.float64)


def most(level: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    return (np.append(THRESHOLDS, THRESHOLDS[-1] * 2)[level] - 1).astype(np.float64)


def tallies(column: pa.Array, grams_of: Callable[[np.ndarray, np.ndarray], np.ndarray], together: int = TALLY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, count), ascending, of each ``together`` bytes of text; only a slice of ``arrays.SLICE_BYTES`` is in tokens at a time."""
    held, size = [], 0
    for _, _, data, off in arrays.slices(column):
        held.append(np.unique(grams_of(*tokens(data, off)), return_counts=True))
        size += len(data)
        if size >= together:
            yield _added(held)
            held, size = [], 0
    if held:
        yield _added(held)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of equal n-grams added up."""
    g, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(n, first) if len(g) else n


def gather(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, bits): the filter over unigrams, contexts and bigrams of all of ``docs``.

    Equal n-grams of about 4 MB of text are added up before the shuffle, so that a very common one is in few rows.
    """

    def grams_of(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate([unigram(tok), unigram(np.full(len(at) - 1, START)), bigrams(tok, at)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, n in tallies(batch.column(0), grams_of):
                block = block_of(g, n_blocks)  # g is sorted, so are the blocks
                edge = np.searchsorted(block, np.arange(n_blocks + 1))
                kind = np.flatnonzero(np.diff(edge))
                cut = np.append(edge[kind], len(g))
                yield pa.RecordBatch.from_arrays([pa.array(kind), arrays.list_array(pa.array(g.view(np.int64)), cut), arrays.list_array(pa.array(n.astype(np.int32)), cut)], ["block", "grams", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                g, n = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                found.setdefault(b, []).append((g.view(np.uint64), n))
        for b in sorted(found):
            parts = found.pop(b)
            g, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            total = np.bincount(place, np.concatenate([n for _, n in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([build_block(g, total).tobytes()], pa.binary())], ["block", "bits"])

    tasks = min(max(8, n_blocks // 4), 4096)
    return docs.select("text").mapInArrow(emit, "block long, grams array<long>, counts array<int>").repartition(tasks, "block").mapInArrow(build, "block long, bits binary")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): exact counts of all token hashes, the end token included."""

    def emit(batches):
        for batch in batches:
            for w, n in tallies(batch.column(0), lambda tok, at: tok):
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(emit, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``, from all of ``train``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end. ``base_score`` uses exact counts. ``score`` is the sum
    of the log10 of ``probability``, from levels of the filter. A null or empty text is its end alone. Repeated rows give a
    row each. Without training rows every token counts 0. Ids may be null or repeat; other columns play no part.
    """
    spark = docs.sparkSession
    docs = common.documents(docs, id_col, text_col)
    train = common.documents(train, id_col, text_col)
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = common.stored(word_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_blocks = max(1, min(1 << 20, -(-size // BYTES_PER_BLOCK)))
    blocks = common.stored(gather(train, n_blocks))
    sizes = blocks.select("block", F.octet_length("bits").alias("n")).orderBy("block").collect()  # 12 bytes per 2 MB of text
    passes, held = [[]], 0
    for b, n in sizes:
        if held + n > BROADCAST_BYTES and passes[-1]:
            passes.append([])
            held = 0
        passes[-1].append(b)
        held += n
    # bounded: WIDESPREAD entries of 16 bytes
    top = common.most_frequent(counts, "c", WIDESPREAD).toArrow()
    word = top["word"].to_numpy().astype(np.int64)
    order = np.argsort(word)
    table = spark.sparkContext.broadcast((word[order], top["c"].to_numpy().astype(np.int64)[order]))
    floor = np.log10(0.5 / (total + 0.5 * (distinct + 1)))
    scale = total + 0.5 * (distinct + 1)

    def read(batches):
        known, c_of = table.value
        for batch in batches:
            for lo, hi, data, off in arrays.slices(batch.column(1)):
                tok, at = tokens(data, off)
                n = hi - lo
                doc = np.repeat(np.arange(n), np.diff(at))
                t = tok.view(np.int64)
                i = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1))
                hit = known[i] == t if len(known) else np.zeros(len(t), bool)
                value = np.log10((c_of[i[hit]] + 0.5) / scale) if len(known) else np.zeros(0)
                base = np.bincount(doc[hit], value, n).astype(np.float64)
                seen = np.bincount(doc[hit], minlength=n)
                kinds, where = np.unique(t[~hit], return_inverse=True)
                pair, freq = np.unique(doc[~hit] * max(1, len(kinds)) + where, return_counts=True)
                rare_at = np.searchsorted(pair // max(1, len(kinds)), np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, n) for c in (batch.column(2), batch.column(0))], pa.array(np.diff(at)), pa.array(seen), pa.array(base), arrays.list_array(pa.array(kinds[pair % max(1, len(kinds))]), rare_at), arrays.list_array(pa.array(freq.astype(np.int32)), rare_at)], ["k", "doc_id", "n_tokens", "seen", "base", "words", "freqs"])

    rows = docs.select("doc_id", "text", common.row_key("doc_id", "text").alias("k"))
    first = common.stored(rows.mapInArrow(read, "k long, doc_id long, n_tokens long, seen long, base double, words array<long>, freqs array<int>"))
    if distinct > len(word):
        # rows alike in id and text have the same rest: it is joined once
        rare = first.filter(F.size("words") > 0).dropDuplicates(["k", "doc_id"]).select("k", "doc_id", F.explode(F.arrays_zip("words", "freqs")).alias("x")).select("k", "doc_id", F.col("x.words").alias("word"), F.col("x.freqs").alias("f"))
        met = rare.join(counts, "word", "left")
        rest = met.groupBy("k", "doc_id").agg(F.sum(F.col("f") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(scale)))).alias("rest"), F.sum(F.when(F.col("c").isNotNull(), F.col("f")).otherwise(0)).alias("more"))
        rest = rest.select(F.col("k").alias("rk"), F.col("doc_id").alias("rid"), "rest", "more")
        first = first.join(rest, (F.col("k") == F.col("rk")) & F.col("doc_id").eqNullSafe(F.col("rid")), "left")
    else:
        # the table holds all words: the others have count 0
        first = first.withColumn("rest", F.aggregate("freqs", F.lit(0), lambda a, x: a + x) * F.lit(float(floor))).withColumn("more", F.lit(0))
    first = first.select("k", "doc_id", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"))
    if len(passes) == 1:
        model = _one_pass(rows, blocks, n_blocks, scale)
    else:
        model = _in_parts(rows, blocks, n_blocks, scale, passes)
    # rows alike in id and text have the same score
    model = model.dropDuplicates(["k", "doc_id"]).select(F.col("k").alias("mk"), F.col("doc_id").alias("mid"), "score")
    out = first.join(model, (F.col("k") == F.col("mk")) & F.col("doc_id").eqNullSafe(F.col("mid")))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def _broadcast(blocks: DataFrame, n_blocks: int, numbers: list[int] | None = None):
    """The filter of these blocks, bounded by the caller: BROADCAST_BYTES at most. A worker holds it once, and drops it with the broadcast."""
    part = blocks if numbers is None else blocks.filter(F.col("block").between(numbers[0], numbers[-1]))
    return blocks.sparkSession.sparkContext.broadcast(Filter(n_blocks, ((r[0], r[1]) for r in part.orderBy("block").toLocalIterator())))


def probability(pair: np.ndarray, context: np.ndarray, word: np.ndarray, scale: float) -> np.ndarray:
    """Of each token after the one before it, from the levels of the two, the first and itself: a mixture of the pair's share
    of its context and the word's smoothed share of all.

    The pair counts with the least, its context with the most that its level stands for, and a word with the least: over all
    words after one context the probabilities sum to at most 1, but for what the filter's false positives add.
    """
    share = np.where(context > 0, least(pair) / np.maximum(1.0, most(context)), 0.0)
    return WEIGHT * np.minimum(1.0, share) + (1 - WEIGHT) * (least(word) + 0.5) / scale


def token_levels(own: Filter, tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Levels of each token's pair with the one before it, of that one, and of itself; 0 where the filter's part has none."""
    kinds, place = np.unique(tok, return_inverse=True)
    word = own.levels(unigram(kinds))[place]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[at[:-1]] = own.levels(unigram(np.array([START])))[0]
    return np.stack([own.levels(bigrams(tok, at)), context, word], 1)


def _one_pass(rows: DataFrame, blocks: DataFrame, n_blocks: int, scale: float) -> DataFrame:
    shared = _broadcast(blocks, n_blocks)

    def run(batches):
        own = shared.value
        for batch in batches:
            for lo, hi, data, off in arrays.slices(batch.column(1)):
                tok, at = tokens(data, off)
                level = token_levels(own, tok, at)
                p = probability(level[:, 0], level[:, 1], level[:, 2], scale)
                total = np.bincount(np.repeat(np.arange(hi - lo), np.diff(at)), np.log10(p), hi - lo).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo), pa.array(total)], ["k", "doc_id", "score"])

    return rows.mapInArrow(run, "k long, doc_id long, score double")


def _in_parts(rows: DataFrame, blocks: DataFrame, n_blocks: int, scale: float, passes: list[list[int]]) -> DataFrame:
    """Each pass reads the documents and writes the levels that its part of the filter knows: three bytes a token, mostly 0.

    An n-gram is in one part, so the levels of all passes add up to those of the whole filter.
    """
    parts = None
    for i, numbers in enumerate(passes):
        shared = _broadcast(blocks, n_blocks, numbers)

        def run(batches, shared=shared, i=i):
            own = shared.value
            for batch in batches:
                for lo, hi, data, off in arrays.slices(batch.column(1)):
                    tok, at = tokens(data, off)
                    now = token_levels(own, tok, at).astype(np.uint8)
                    out = [now[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo), pa.array([i] * (hi - lo), pa.int32()), pa.array(out, pa.binary())], ["k", "doc_id", "pass", "levels"])

        part = common.stored(rows.mapInArrow(run, "k long, doc_id long, pass int, levels binary"))
        parts = part if parts is None else parts.union(part)

    def total(batches):
        for batch in batches:
            scores = []
            for each in batch.column(2).to_pylist():
                level = sum(np.frombuffer(x, np.uint8).astype(np.int64) for x in each).reshape(-1, 3)
                scores.append(float(np.log10(probability(level[:, 0], level[:, 1], level[:, 2], scale)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["k", "doc_id", "score"])

    # rows alike in id and text have the same levels: one set of them per pass
    whole = parts.groupBy("k", "doc_id").agg(F.collect_set(F.struct("pass", "levels")).alias("x")).select("k", "doc_id", F.transform("x", lambda x: x["levels"]).alias("x"))
    return whole.mapInArrow(total, "k long, doc_id long, score double")


def held_out():
    """Whether the remainder of the id's checksum holds a document out; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, by a model of all that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, docs.filter(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
