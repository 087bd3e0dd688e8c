"""Ranks of rows by a distributed LSD radix sort.

The rows stand in an order of their own, cut into blocks of bounded size. A pass takes one digit of the key, the least
significant first: digits are counted per block; offsets over all digits, and over the blocks before within a digit, tell
where each block's rows of a digit go; a stable counting sort within the block gives each row its destination. After the last
pass the destination is the rank. A digit that all rows share costs nothing special, as no group is larger than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm import common

#: Rows of a block.
BLOCK_BITS = 18
DIGIT_BITS = 16


def offset_key(key: str, low: int, high: int) -> Column:
    """``key`` as an unsigned number from 0: what it is above the least, or with the sign turned where that does not fit a long."""
    return F.col(key) - F.lit(low) if high - low < 1 << 63 else F.col(key).bitwiseXOR(F.lit(-(1 << 63)))


def digits_of(low: int, high: int) -> list[tuple[int, int]]:
    """(shift, bits) of the digits that differ between keys from ``low`` to ``high``, the least significant first."""
    bits = (high - low).bit_length()
    passes = -(-bits // DIGIT_BITS)
    width = -(-bits // max(1, passes))
    return [(i * width, min(width, bits - i * width)) for i in range(passes)]


def counting_pass(rows: DataFrame, key: str, shift: int, bits: int) -> DataFrame:
    """``rows`` (with ``_block`` and ``_pos``) after one stable pass over a digit of ``key``: ``_pos`` from 0, ``_block`` by it."""
    digit = F.shiftrightunsigned(F.col(key), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    counts = common.stored(rows.groupBy("_block", digit.alias("_digit")).agg(F.count("*").alias("_n")))
    totals = np.zeros(1 << bits, np.int64)
    for r in counts.groupBy("_digit").agg(F.sum("_n")).collect():  # bounded: a row per digit
        totals[r[0]] = r[1]
    first = rows.sparkSession.sparkContext.broadcast(np.cumsum(totals) - totals)  # bounded: 8 bytes per digit
    w = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_block", "_digit", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    at, names = rows.columns.index(key), rows.columns

    def move(left: pa.Table, right: pa.Table) -> pa.Table:
        pos = left.column("_pos").to_numpy()
        left = left.take(pa.array(np.argsort(pos)))
        d = ((left.column(at).to_numpy().view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(d, kind="stable")
        count = np.bincount(d, minlength=1 << bits)
        place = np.empty(len(d), np.int64)
        place[order] = np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)
        off = first.value.copy()
        off[right.column("_digit").to_numpy()] += right.column("_before").to_numpy()
        place += off[d]
        return pa.table([*[left.column(c) for c in names if c not in ("_block", "_pos")], pa.array(place >> BLOCK_BITS), pa.array(place)], [*[c for c in names if c not in ("_block", "_pos")], "_block", "_pos"])

    schema = rows.select(*[c for c in names if c not in ("_block", "_pos")], "_block", "_pos").schema
    out = common.stored(rows.groupBy("_block").cogroup(before.groupBy("_block")).applyInArrow(move, schema))
    common.drop_stored(counts)
    return out


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 by ``keys``, rising, the first the most significant.

    Keys are long columns without nulls; rows with equal keys have ranks next to each other, in an order fixed when they are
    first stored. The rows should be few columns: each pass writes them. An empty table gives no row.
    """
    mid = F.monotonically_increasing_id()
    rows = common.stored(rows.select("*", mid.alias("_pos")).withColumn("_block", F.shiftright("_pos", BLOCK_BITS)))
    ends = rows.agg(*[f(k) for k in keys for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return rows.select("*", F.lit(0).cast("long").alias("rank")).drop("_pos", "_block")
    passes = []
    for i, k in enumerate(keys):
        low, high = ends[2 * i], ends[2 * i + 1]
        rows = rows.withColumn(f"_u{i}", offset_key(k, low, high))
        passes = [(f"_u{i}", *d) for d in digits_of(low, high)] + passes
    # rows without a digit to sort by are all equal: one pass over nothing still numbers them
    for key, shift, bits in passes or [("_u0", 0, 0)]:
        after = counting_pass(rows, key, shift, bits)
        common.drop_stored(rows)
        rows = after
    return rows.withColumn("rank", F.col("_pos") + 1).drop("_pos", "_block", *[f"_u{i}" for i in range(len(keys))])
