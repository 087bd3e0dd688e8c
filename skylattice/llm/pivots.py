"""Embedding near-dedup by a pivot-permutation index.

Every vector is described by its nearest pivots in order, the nearest first. An inverted list holds the vectors of
a label that have two given pivots among their nearest ones, each with the places of the two in its order. Two vectors
of a list share these pivots if they have them at nearly the same places; vectors that share enough pivots are
candidates, and the exact cosine decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import arrays, common

COSINE = 0.98
#: Nearest pivots that describe a vector.
NEAREST = 8
#: Pivots that two vectors share at least to be compared.
SHARED = 3
#: How far apart the places of a shared pivot in two orders may be.
SHIFT = 4
#: Pivots: one per VECTORS_PER_PIVOT vectors within these bounds; they are a sample of the vectors themselves.
PIVOTS = (64, 16_384)
VECTORS_PER_PIVOT = 16


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each vector scaled by its largest component first so that squares stay finite."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def lists_of(vectors: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """(c, label, key, i, j): the inverted lists that each vector is in, one per two of its nearest pivots, and their places."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots.astype(np.float32))  # bounded: PIVOTS[1] rows
    near = min(nearest, len(pivots))
    two = list(combinations(range(near), 2)) or [(0, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        left, right = np.array([i for i, _ in two]), np.array([j for _, j in two])
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = matrix(part.column(2))
                x /= np.abs(x).max(1, keepdims=True)
                close = x.astype(np.float32) @ p.T
                top = np.argpartition(-close, near - 1, axis=1)[:, :near]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1)
                a, b = top[:, left].astype(np.int64), top[:, right].astype(np.int64)
                turned = a > b  # a list is named by its pivots, the smaller number first
                key = np.where(turned, b, a) * len(p) + np.where(turned, a, b)
                i, j = np.where(turned, right, left), np.where(turned, left, right)
                off = np.arange(part.num_rows + 1) * len(two)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), arrays.list_array(pa.array(key.ravel()), off), arrays.list_array(pa.array(i.ravel().astype(np.int32)), off), arrays.list_array(pa.array(j.ravel().astype(np.int32)), off)], ["c", "label", "keys", "is", "js"])

    listed = vectors.select("c", "label", "v").mapInArrow(run, "c long, label long, keys array<long>, is array<int>, js array<int>")
    return listed.select("c", "label", F.explode(F.arrays_zip("keys", "is", "js")).alias("x")).select("c", "label", F.col("x.keys").alias("key"), F.col("x.is").alias("i"), F.col("x.js").alias("j"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Vectors of equal, non-null label link at ``cosine`` or more in double precision. Null and zero vectors, those with
    null or non-finite components and rows with a null label or id link with nothing. Vectors of different lengths do
    not link. Identical vectors of a label are one class: its members link with each other and share the class's links.
    Repeated rows (same id, label and vector) are separate members. The index holds every vector; only pivots are
    sampled. A candidate needs ``shared`` common pivots out of ``nearest``, so recall is not proven; see the tests.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    plain = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good &= F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = plain.withColumn("good", good).withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(7), "v", "label"))
    keys = common.stored(rows.select("vec_id", "good", "h1", "h2"))
    found = keys.filter("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
    # the class's number is its hash: ids may repeat with other vectors
    one = rows.filter("good").join(found, ["h1", "h2"]).filter("vec_id = first").dropDuplicates(["h1", "h2"])
    classes = common.stored(one.select(F.col("h1").alias("c"), "h2", "label", "v", "first", "m"))
    sizes = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    links = None
    for size in sorted(sizes):
        own = classes.filter(F.size("v") == size)
        n = own.count()
        want = min(max(n // VECTORS_PER_PIVOT, PIVOTS[0]), PIVOTS[1])
        p = matrix(own.select("c", "v").orderBy(F.xxhash64("c")).limit(want).toArrow().column("v"))
        p = p / np.linalg.norm(p / np.abs(p).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(p).max(1, keepdims=True)
        lists = common.stored(lists_of(own, p, nearest))
        need = min(shared, len(p))
        meet = lists.alias("l").join(lists.alias("r"), (F.col("l.label") == F.col("r.label")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.c") < F.col("r.c")) & (F.abs(F.col("l.i") - F.col("r.i")) <= SHIFT) & (F.abs(F.col("l.j") - F.col("r.j")) <= SHIFT))
        # s shared pivots meet in s (s - 1) / 2 lists
        pairs = meet.groupBy(F.col("l.c").alias("a"), F.col("r.c").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= max(1, need * (need - 1) // 2)).select("a", "b")
        part = _verified(pairs, own, cosine)
        links = part if links is None else links.union(part)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    links = common.stored(links)
    group = common.components(links)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = both.join(classes.select(F.col("c").alias("b"), "m"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("m").alias("links"))
    info = classes.join(weight, "c", "left").join(group, F.col("c") == F.col("node"), "left").select(F.col("c").alias("h1"), "h2", "first", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("g"))
    names = info.groupBy("g").agg(F.min("first").alias("component_id"))
    named = info.join(names, "g").select("h1", "h2", "n_links", "component_id")
    out = keys.join(named, ["h1", "h2"], "left")
    linked = F.col("good")
    out = out.select("vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    wide = pairs.join(vectors.select(F.col("c").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("c").alias("b"), F.col("v").alias("vb")), "b")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                ok = cosines(matrix(part.column(2)), matrix(part.column(3))) >= cosine
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return wide.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings``."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
