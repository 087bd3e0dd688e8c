"""Embedding whitening with covariances by polarisation.

With y = n x - S, the centred value times the number of vectors, every sum is one of squares of integers: of y in each
dimension, and of y_i + y_j for each pair of dimensions. Half of what the squares of a pair's sum exceed those of its two
members by is the pair's cross-covariance. The sums are exact, so that the covariance does not depend on how the vectors
are dealt to tasks; the matrix of few dimensions goes to ``eigh`` on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import common

SCALE = 256
COMPONENTS = 4
#: Bits of a limb, and rows at a time: products of two limbs of so many rows sum within 64 bits.
LIMB = 24
BLOCK = 1 << 14
#: Tasks per core that gather sums: each sends dimensions * (dimensions + 1) / 2 rows.
TASKS_PER_CORE = 2
EXACT = pa.decimal128(38, 0)


def integers(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def square_sums(w: np.ndarray, axis: int, limbs: int) -> np.ndarray:
    """Exact sums of squares along an axis of at most BLOCK entries, as Python integers; entries have ``limbs`` limbs at most."""
    parts = [(w >> LIMB * k) & (1 << LIMB) - 1 for k in range(limbs - 1)] + [w >> LIMB * (limbs - 1)]
    total = 0
    for a, x in enumerate(parts):
        for b, y in enumerate(parts[: a + 1]):
            total = total + (x * y).sum(axis).astype(object) * ((1 if a == b else 2) << LIMB * (a + b))
    return total


def exact(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def _blocks(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            yield part, integers(part.column(at), size)


def dimension_sums(fit: DataFrame, size: int) -> tuple[int, list[int], int]:
    """(vectors, sum per dimension, largest magnitude) of the vectors ``x`` of ``size`` entries."""

    def run(batches):
        n, total, top = 0, np.zeros(size, object), 0
        for _, x in _blocks(batches, 0, size):
            n += len(x)
            total = total + ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
            top = max(top, abs(int(x.min())), abs(int(x.max())))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), exact(total), exact([n] * size), exact([top] * size)], ["i", "s", "n", "top"])

    kind = "i int, s decimal(38,0), n decimal(38,0), top decimal(38,0)"
    rows = fit.mapInArrow(run, kind).groupBy("i").agg(F.sum("s"), F.sum("n"), F.max("top")).orderBy("i").collect()
    return int(rows[0][2]), [int(r[1]) for r in rows], int(rows[0][3])


def covariance(fit: DataFrame, size: int) -> tuple[int, np.ndarray, int, np.ndarray]:
    """(n, S, limbs of y, covariance) of the distinct vectors ``x``, each entry of the matrix the rounded exact value."""
    spark = fit.sparkSession
    few = fit.select("x").coalesce(spark.sparkContext.defaultParallelism * TASKS_PER_CORE)
    n, sums, top = dimension_sums(few, size)
    if 4 * n * top >= 1 << 62 or 4 * n**3 * top**2 >= 10**37:
        raise ValueError(f"{n} vectors of entries up to {top} have sums of more than 38 digits")
    limbs = -(-(4 * n * top).bit_length() // LIMB) or 1
    s = np.array(sums, np.int64)

    def run(batches):
        own, pairs = np.zeros(size, object), [np.zeros(size - 1 - i, object) for i in range(size)]
        empty = True
        for _, x in _blocks(batches, 0, size):
            empty = False
            y = np.asfortranarray(n * x - s)
            own = own + square_sums(y, 0, limbs)
            for i in range(size - 1):
                pairs[i] = pairs[i] + square_sums(y[:, i + 1 :] + y[:, i : i + 1], 0, limbs)
        if not empty:
            for i in range(size):
                js = list(range(i, size))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(js), pa.int32()), pa.array(js, pa.int32()), exact([own[i], *pairs[i]])], ["i", "j", "q"])

    told = few.mapInArrow(run, "i int, j int, q decimal(38,0)").groupBy("i", "j").agg(F.sum("q").alias("q")).collect()  # bounded by dimensions squared
    q = {(r[0], r[1]): int(r[2]) for r in told}
    v = np.zeros((size, size))
    for (i, j), value in q.items():
        cross = value if i == j else (value - q[i, i] - q[j, j]) // 2
        v[i, j] = v[j, i] = cross / n**3
    return n, s, limbs, v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), the largest first; of each vector the largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return e, u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component, of ``most`` at most.

    Vectors that are null, or hold null, infinite or NaN entries, or entries of 2**54 or more, go; others become
    x = floor(256 * entry). The covariance is that of the distinct x, however often each occurs, so that copies weigh nothing.
    Vectors of another length are a space of their own, with its own n and components. Empty vectors have no component and
    give no row. A component without variance (all vectors equal, or fewer than dimensions) has no whitened value: null, and
    is left out of ``identity_error``, which is null if none has. Repeated rows and null ids give rows of their own.
    ``deviation`` is a decimal of 38 digits. An empty table gives no row.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    plain = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    good = plain.filter(F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**54))), F.lit(False)))
    x = good.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c)).alias("x"))
    # copies go before the shuffle; a lost executor finds the list in the shared folder
    fit = common.stored(x.select("x").distinct())
    out = None
    for size in sorted(r[0] for r in fit.select(F.size("x")).distinct().collect() if r[0]):
        part = _whitened(x.filter(F.size("x") == size), fit.filter(F.size("x") == size), size, most)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out


def _whitened(rows: DataFrame, fit: DataFrame, size: int, most: int) -> DataFrame:
    n, s, limbs, v = covariance(fit, size)
    e, u = components(v, most)
    k, trace = len(e), float(np.trace(v))
    real = e > trace * size * np.finfo(float).eps
    explained = [float(x) / trace if trace > 0 else None for x in e]
    turn = np.where(real, u / np.sqrt(np.where(real, e, 1.0)), np.nan)

    def projected(y: np.ndarray) -> np.ndarray:
        return (y / n) @ turn

    def whitened(batches):
        for _, x in _blocks(batches, 0, size):
            w = projected(n * x - s)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in range(k)], [f"w{c}" for c in range(k)])

    error = None
    if real.any():
        pairs = [(a, b) for a in range(k) for b in range(a, k) if real[a] and real[b]]
        told = fit.select("x").mapInArrow(whitened, ", ".join(f"w{c} double" for c in range(k))).agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
        error = max(abs(c - (a == b)) for c, (a, b) in zip(told, pairs))

    def run(batches):
        for part, x in _blocks(batches, 1, size):
            m = len(x)
            y = n * x - s
            far = sum(square_sums(y[:, lo : lo + BLOCK], 1, limbs) for lo in range(0, size, BLOCK))
            w = projected(y).ravel()
            ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), exact(np.repeat(far, k)), pa.array(w, mask=np.isnan(w)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whiten`` of every row of ``embeddings``, four components; ``deviation`` as long, an error if it needs more than 63 bits."""
    return whiten(common.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
