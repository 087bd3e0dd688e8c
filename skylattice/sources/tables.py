"""Tables between the steps of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new name in the folder all executors share: ``spark.checkpoint.dir``, or the warehouse if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/skylattice-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder all executors share, and read again.

    For what is used twice and costly: it is computed once, and a lost executor loses none of it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or groups at a time where ``dealt`` says how many tasks there are.
ROWS_PER_TASK = 1 << 18


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``by`` over as many tasks as hold ROWS_PER_TASK each.

    Below Spark's own number of shuffle partitions it stays as it is: these are small enough, and Spark joins small ones.
    """
    tasks = -(-rows // ROWS_PER_TASK)
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
