"""Helpers shared by the operators: tables, row keys, checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors reach: in ``spark.checkpoint.dir``, or in the warehouse if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/skylattice-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a write once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, so a lost executor costs no recomputation.

    Nothing reads the shuffle files of the write again; they go at once.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest values of ``count`` (1 or more), as many whole classes of values as make ``most`` rows at most.

    Values are counted in classes of a sixteenth of an octave: a small table tells where to cut, no row is sorted.
    """
    kind = F.floor(16 * F.log2(F.col(count).cast("double")))
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(kind.alias("x")).agg(F.count("*")).collect()), reverse=True)
    least, held = None, 0
    for x, n in sizes:
        held += n
        if held > most:
            break
        least = x
    return counts.filter(F.lit(False)) if least is None else counts.filter(kind >= least)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/skylattice-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row by content: rows that repeat an id with another text stay apart; rows equal in both behave alike."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns (doc_id, text) of any frame; other columns, whatever their names, play no part."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``: the smallest node reachable, by alternating large and small stars.

    Each round is written to the shared folder. Edges are pairs of ids; loops are dropped, an empty input gives no rows.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stored(hung.union(low.select("a", F.col("m").alias("b"))).distinct())
        drop_stored(edges)
        edges = small
        # settled when all edges are those of stars: a node hangs on one other, and none hangs on it
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").agg(F.count("*")).first()[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
