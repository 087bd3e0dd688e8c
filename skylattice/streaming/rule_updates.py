"""Updates files of connection-time rules as a stream: each batch is one delta on the rules so far.

The state is a table of versions, one per batch. Batch b reads version b - 1 and writes version b whole (rules are a
dimension), so a batch that runs again after a failure finds what it found before and writes what it wrote before. A version
counts once its write has ended; the two last are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylattice.operators import maintenance, mct

FIELDS = ["owner", "rule_pos", *maintenance.CONTENT]
TYPES = {"rule_pos": "long", "suppression": "boolean", **dict.fromkeys(mct.FLAGS, "boolean")}
STATE = ", ".join(f"{f} {TYPES.get(f, 'string')}" for f in FIELDS)


def version_path(path: str, batch: int) -> str:
    return f"{path}/version={batch}"


def version(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The rules after batch ``batch``; none before the first."""
    if batch < 0:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(version_path(path, batch))


def apply(batch: DataFrame, number: int, path: str, airports: DataFrame) -> None:
    """Writes version ``number``: the rules before with the deletes, then the adds, of ``batch``; the same again if run again."""
    spark = batch.sparkSession
    after = maintenance.delta(version(spark, path, number - 1), batch, airports)
    after.select(*[F.col(f).cast(TYPES.get(f, "string")).alias(f) for f in FIELDS]).write.mode("overwrite").parquet(version_path(path, number))
    if number >= 2:  # emptied, not deleted: a table of no rows takes no room
        spark.createDataFrame([], STATE).write.mode("overwrite").parquet(version_path(path, number - 2))


def follow(updates: DataFrame, path: str, checkpoint: str, airports: DataFrame) -> StreamingQuery:
    """Starts a query that applies each batch of ``updates`` (rules with ``action`` A or D, in ``rule_pos`` order) and ends when none is left.

    What is there when it starts is one batch, a delta: a large update may be many files, written before. One file a batch
    (``maxFilesPerTrigger``) makes each file a delta of its own, in order of time.
    """
    write = updates.writeStream.foreachBatch(lambda batch, number: apply(batch, number, path, airports))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, query: StreamingQuery) -> DataFrame:
    """The rules after the last batch of a query that has ended."""
    done = query.lastProgress
    return version(spark, path, -1 if done is None else done["batchId"] if done["numInputRows"] or done["batchId"] == 0 else done["batchId"] - 1)
