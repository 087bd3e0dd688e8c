"""Importance resampling of documents towards a target: weights from hashed words, the draw by a distributed radix sort.

Words of both sides are counted in buckets; the gain of a bucket, the scaled logarithm of how much more frequent it is in the
target, is one entry of an array that every task holds. A document's weight is the floored mean of its words' gains. With a
Gumbel number made from its id added, the highest scores are a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common, radix

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Bytes that words are made of, after A-Z became a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Words longer than this are finished one by one.
SHORT = 48


@functools.cache
def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of data[start:end] for many spans at once, byte position by byte position."""
    table, lens = crc_table(), end - start
    order = np.argsort(-np.minimum(lens, SHORT), kind="stable")
    at, sizes = start[order], lens[order]
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for j in range(int(min(SHORT, sizes[0])) if len(sizes) else 0):
        k = len(sizes) - int(np.searchsorted(np.minimum(sizes, SHORT)[::-1], j, "right"))
        crc[:k] = table[(crc[:k] ^ data[at[:k] + j]) & np.uint32(255)] ^ (crc[:k] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > SHORT).tolist():
        crc[i] = zlib.crc32(data[at[i] + SHORT : at[i] + sizes[i]].tobytes(), int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def buckets_of(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bucket of each word, words before each document) of slices of a text column."""
    for lo, hi, data, off in arrays.slices(column):
        data = LOWER[data]
        words = arrays.Words(data, off, IS_WORD[data])
        yield lo, hi, (crc32_of(data, words.start, words.end) % np.uint32(buckets)).astype(np.int64), words.off


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Words per bucket over all texts; a task sends each of its buckets once."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, b, _ in buckets_of(batch.column(0), buckets):
                total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for b, n in texts.select(texts[text_col].cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # bounded by the buckets
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of shares), each share smoothed by one word per bucket, in doubles."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score) of each row."""
    table = docs.sparkSession.sparkContext.broadcast(gain)  # bounded by the buckets

    def run(batches):
        g = table.value
        for batch in batches:
            for lo, hi, b, off in buckets_of(batch.column(1), len(g)):
                ids, n = batch.column(0).slice(lo, hi - lo), np.diff(off)
                total = np.concatenate([[0], np.cumsum(g[b])])
                weight = (total[off[1:]] - total[off[:-1]]) // np.maximum(n, 1)
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(score)], ["doc_id", "n_features", "weight", "score"])

    return common.documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; ``rank`` from 1 of the ``percent`` of long enough rows drawn, else null.

    Ties go to the smaller id, null ids last; rows equal in score and id are told apart by where they are stored. A null or
    empty text has no words, weight 0, and is not drawn. An empty target, or one whose texts are null, has smoothed shares
    alone. Repeated rows count, and are drawn, each for itself. Null ids share one Gumbel number. An empty table gives no row.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = common.stored(scored(docs, gain, id_col, text_col, seed))
    long = rows.filter(F.col("n_features") >= least_words)
    drawn = long.count() * percent // 100
    keyed = long.select("*", (-F.col("score")).alias("_high"), F.col("doc_id").isNull().cast("long").alias("_none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"))
    done = radix.ranked(keyed, ["_high", "_none", "_id"]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_features") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return done.select(rest.columns).unionByName(rest)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resample`` of every row of ``documents`` towards ``benchmark``, with the defaults."""
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The same in SQL: the checksum goes by half bytes, with the polynomial's remainders of 0 to 15 (fixed values).
OP12_SQL = r"""WITH texts AS (SELECT 0 AS side, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents UNION ALL SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
docs AS (SELECT side, doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
words AS (SELECT side, r, unnest(w) AS word FROM docs),
halves AS (SELECT word, list_transform(string_split(hex(encode(word)), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS h FROM (SELECT DISTINCT word FROM words)),
low_first AS (SELECT word, list_transform(range(len(h)), lambda i: h[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) AS h FROM halves),
bucket AS (SELECT word, xor(list_reduce(h, lambda a, x: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][xor(a & 15, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS b FROM low_first),
n AS (SELECT b, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM words JOIN bucket USING (word) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n),
w AS (SELECT r, sum(gain) AS total FROM words JOIN bucket USING (word) JOIN g USING (b) WHERE side = 0 GROUP BY r),
d AS (SELECT doc_id, len(w) AS n_features, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE floor(total / len(w)) END AS BIGINT) AS weight FROM docs LEFT JOIN w USING (r) WHERE side = 0),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= floor(10 * m / 100) THEN place END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS m FROM x)"""
