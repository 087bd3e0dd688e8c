"""MinHash near-dedup with fast similarity sketching.

A sketch has BINS coordinates. Round i throws every shingle into one random bin with the value i + u; a bin
keeps its smallest value. After the first BINS rounds, round BINS + j sends all shingles to bin j, so every bin
fills. Few rounds suffice for long texts, and coordinates agree with the probability of the Jaccard similarity.
Bands of ROWS coordinates give candidates; full shingle sets confirm. In a bucket all sets are compared with a
centre only; what a centre leaves apart is searched by the shingles in which the sets depart from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common

WORDS = 3
PERCENT = 85
ROWS = 5
BANDS = 32
BINS = ROWS * BANDS


def sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a slice, end to end and sorted, and where each begins."""
    found = arrays.Words(data, off)
    h = found.hashes(lower=True)
    count = found.counts
    doc = np.repeat(np.arange(len(count)), count)
    parts, owner = [], []
    grams = arrays.kgrams(h, words)
    whole = doc[: len(grams)] == doc[words - 1 :]
    parts.append(grams[whole])
    owner.append(doc[: len(grams)][whole])
    for n in range(1, words):  # a shorter text is one shingle
        for d in np.flatnonzero(count == n):
            parts.append(arrays.kgrams(h[found.off[d] : found.off[d + 1]], n))
            owner.append(np.array([d]))
    grams, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(count) + 1))


def sketch(grams: np.ndarray, off: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates per document; rows of empty sets are all ones."""
    n = len(off) - 1
    out = np.full(n * bins, ~np.uint64(0))
    active = np.flatnonzero(np.diff(off))
    low = np.uint64((1 << 52) - 1)
    for i in range(2 * bins):
        if not len(active):
            break
        size = off[active + 1] - off[active]
        at = arrays.ragged(off[active], size)
        doc = np.repeat(active, size)
        x = arrays.mix(grams[at] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = (x & low) + (np.uint64(i) << np.uint64(52))
        bin_of = ((x >> np.uint64(52)) * np.uint64(bins) >> np.uint64(12)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        np.minimum.at(out, doc * bins + bin_of, value)
        full = (out.reshape(n, bins)[active] != ~np.uint64(0)).all(1)
        active = active[~full]
    return out.reshape(n, bins)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    n = len(sketches)
    s = arrays.mix(sketches).reshape(n, BANDS, ROWS)
    h = np.full((n, BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = arrays.mix(h * arrays.BASE + s[:, :, r])
    return h


def _summary(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, k, n_shingles, s1, s2, keys): two independent sums identify the set; keys are its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in arrays.slices(batch.column(1)):
                grams, at = sets(data, off, words)
                total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[at])  # noqa: B023, E731
                keys = band_keys(sketch(grams, at)).view(np.int64)
                list_off = np.arange(hi - lo + 1) * BANDS
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(total(grams).view(np.int64)), pa.array(total(arrays.mix(grams)).view(np.int64)), arrays.list_array(pa.array(keys.ravel()), list_off)], ["doc_id", "k", "n_shingles", "s1", "s2", "keys"])

    return docs.select("doc_id", "text", common.row_key("doc_id", "text").alias("k")).mapInArrow(run, "doc_id long, k long, n_shingles long, s1 long, s2 long, keys array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of those pairs of class ids whose full sets reach ``percent``; ``texts`` has (c, text)."""
    wide = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                # each text is hashed once per block of pairs
                a, b = part.column("ta").dictionary_encode(), part.column("tb").dictionary_encode()
                own = [sets_of(c.dictionary, words) for c in (a, b)]
                keep = []
                for i, j in zip(a.indices.to_pylist(), b.indices.to_pylist()):
                    x, y = own[0][i], own[1][j]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                    inter = int((y[at] == x).sum()) if len(y) else 0
                    keep.append(inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            arrays.release()

    return wide.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def departures(apart: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): every pair of members of one centre, in different groups, that may reach ``percent``; none is lost.

    ``apart`` has (z, k, g): the classes k in buckets of centre z, and their groups. With Z the centre's set, D(x) the
    shingles in which x and Z differ, m of them only in Z and e only in x, let w(x) = 100 m + percent e and room =
    (100 - percent) |Z|. Then x and y reach ``percent`` exactly if w(x) + w(y) <= room + (100 + percent) |D(x) & D(y)|.
    If neither has w above room, both link with Z and are in its group. So one of them, y, has w(y) > room, and they share
    at least w(x) / (100 + percent) shingles of D(x) and (w(y) - room) / 100 of D(y). They meet by one of the rarest
    |D| - that + 1 of each; copies of Z with few changes of their own share none.
    """
    wide = apart.join(texts.select(F.col("c").alias("z"), F.col("text").alias("tz")), "z").join(texts.select(F.col("c").alias("k"), F.col("text").alias("tk")), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                centre = part.column("tz").dictionary_encode()
                held = [sets_of(centre.dictionary, words), sets_of(part.column("tk"), words)]
                w, room, off, d = [], [], [0], []
                for i, x in zip(centre.indices.to_pylist(), held[1]):
                    z = held[0][i]
                    only = np.setxor1d(z, x, assume_unique=True)
                    m = (len(only) + len(z) - len(x)) // 2
                    w.append(100 * m + percent * (len(only) - m))
                    room.append((100 - percent) * len(z))
                    d.append(only)
                    off.append(off[-1] + len(only))
                yield pa.RecordBatch.from_arrays([*part.select(["z", "k", "g"]).columns, pa.array(w, pa.int64()), pa.array(room, pa.int64()), arrays.list_array(pa.array(np.concatenate(d).view(np.int64)), np.array(off))], ["z", "k", "g", "w", "room", "d"])

    told = wide.select("z", "k", "g", "tz", "tk").mapInArrow(run, "z long, k long, g long, w long, room long, d array<long>")
    rows = common.stored(told)
    each = rows.select("z", "k", "g", "w", "room", F.explode("d").alias("s"))
    common_ = rows.select("z", F.explode("d").alias("s")).groupBy("z", "s").agg(F.count("*").alias("f")).filter("f > 1")
    # shingles of frequency 1 come first in the order and meet nothing: only their number counts
    held = each.join(common_, ["z", "s"]).groupBy("z", "k", "g", "w", "room").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("o"))
    held = held.withColumn("out", F.col("w") > F.col("room"))
    least = F.when(F.col("out"), F.ceil((F.col("w") - F.col("room")) / 100)).otherwise(F.ceil((F.col("w") + 1) / (100 + percent)))
    held = held.withColumn("take", (F.size("o") - F.greatest(least, F.lit(1)) + 1).cast("int")).filter("take > 0")
    held = held.select("z", "k", "g", "w", "room", F.size("o").alias("n"), "out", F.posexplode(F.expr("slice(o, 1, take)")).alias("i", "x")).select("z", "k", "g", "w", "room", "n", "out", "i", F.col("x.s").alias("s"))
    left, right = held.filter("out").alias("l"), held.alias("r")
    near = (F.col("l.z") == F.col("r.z")) & (F.col("l.s") == F.col("r.s")) & (F.col("l.g") != F.col("r.g")) & (~F.col("r.out") | (F.col("l.k") < F.col("r.k")))
    # they share no more than what is before this place in both, this one, and what is behind it in both
    most = F.least("l.i", "r.i") + 1 + F.least(F.col("l.n") - F.col("l.i"), F.col("r.n") - F.col("r.i")) - 1
    near &= F.col("l.w") + F.col("r.w") <= F.col("l.room") + (100 + percent) * most
    return left.join(right, near).select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b")).distinct()


def sets_of(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for _, _, data, off in arrays.slices(column):
        grams, at = sets(data, off, words)
        out += [grams[i:j] for i, j in zip(at[:-1], at[1:])]
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, k, first) of each row: groups linked by Jaccard similarity of distinct word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; fewer words than a shingle has are one shingle. Texts that are
    null, empty or blank link with nothing. Documents of equal sets form a class that goes on as one. In each bucket
    all classes are compared with one centre; classes that are still in different groups meet by ``departures``. Groups,
    not all pairs, are the result. Rows go by their key ``k`` (see ``common.row_key``): texts that share an id are no
    group for that, and rows with a null id take part. ``component_id`` is the smallest id of the group, null if all are;
    ``kept`` is whether it is the row's own. ``first`` is true for the rows of one key of the group, of a null id only if
    all have one. Repeated rows give a row each.
    """
    docs = common.documents(docs, id_col, text_col)
    rows = common.stored(_summary(docs, words))
    full = rows.filter("n_shingles > 0")
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    classes = common.stored(full.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct(unnamed, "doc_id", "k", "keys")).alias("x")).select("s1", "s2", F.col("n_shingles").alias("n"), F.col("x.doc_id").alias("c"), F.col("x.k").alias("k"), F.col("x.keys").alias("keys")))
    buckets = classes.select("k", "n", F.explode("keys").alias("bucket"))
    met = common.stored(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "bucket"))
    # the class that meets most others is the most typical one: the best centre of its buckets
    fame = met.groupBy("k").agg(F.sum("m").alias("f"))
    centres = met.join(fame, "k").groupBy("bucket").agg(F.max(F.struct("f", "k", "n")).alias("x")).select("bucket", F.col("x.k").alias("z"), F.col("x.n").alias("nz"))
    members = common.stored(met.join(centres, "bucket").filter("k <> z").select("z", "nz", "k", "n").distinct())
    star = members.filter(f"nz * 100 >= n * {percent} and n * 100 >= nz * {percent}").select(F.least("z", "k").alias("a"), F.greatest("z", "k").alias("b")).distinct()
    keyed = docs.select(common.row_key("doc_id", "text").alias("c"), "text")
    texts = common.stored(keyed.join(met.select(F.col("k").alias("c")).distinct(), "c", "left_semi").dropDuplicates(["c"]))
    links = common.stored(confirm(star, texts, words, percent))
    group = common.components(links)
    # centres whose members are still of several groups
    open_ = common.stored(members.join(group, F.col("k") == F.col("node"), "left").select("z", "k", F.coalesce("component", "k").alias("g")))
    spread = open_.groupBy("z").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1").select("z")
    pairs = common.stored(departures(open_.join(spread, "z", "left_semi"), texts, words, percent).join(star, ["a", "b"], "left_anti"))
    links = links.union(common.stored(confirm(pairs, texts, words, percent)))
    group = common.components(links)
    # the smallest doc_id of a group stands for it
    member = classes.join(group, classes.k == group.node, "left").select("s1", "s2", F.col("n").alias("n_shingles"), "c", "k", F.coalesce("component", "k").alias("g"))
    names = member.groupBy("g").agg(F.min(F.struct(F.col("c").isNull().alias("unnamed"), "c", "k")).alias("x")).select("g", F.col("x.c").alias("component_id"), F.col("x.k").alias("one"))
    named = member.join(names, "g").select("s1", "s2", "n_shingles", "component_id", "one")
    out = full.select("doc_id", "n_shingles", "s1", "s2", "k").join(named, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "k", (F.col("k") == F.col("one")).alias("first"))
    return out.union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True), "k", F.lit(True)))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document, by three-word shingles and 85 per cent."""
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
