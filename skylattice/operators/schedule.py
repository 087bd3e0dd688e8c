"""Schedules: legs in blocks and spans, calendar expansion, merged flights and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, keys: list[str], order: list[str], boundary: Column) -> DataFrame:
    """Adds ``block``: it rises at each row where ``boundary`` holds, in order within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("block", F.sum(F.when(boundary, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def serial_breaks(rows: DataFrame, keys: list[str], order: list[str], serial: str) -> DataFrame:
    """(keys, breaks): how often the serial number is not its predecessor plus one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_p", F.lag(serial).over(w)).groupBy(*keys).agg(F.count_if(F.col(serial) != F.col("_p") + 1).alias("breaks"))


def spans(legs: DataFrame, keys: list[str], position: str) -> DataFrame:
    """All contiguous runs of the legs of a group: (keys, first, last), first <= last."""
    a = legs.groupBy(*keys).agg(F.max(position).alias("_n"))
    a = a.select(*keys, "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("first"))
    return a.select(*keys, "first", F.explode(F.sequence(F.col("first"), F.col("_n"))).alias("last"))


def operating_dates(plans: DataFrame) -> DataFrame:
    """One row per date on which a plan operates: its weekday digit is in ``days``, every ``frequency``-th week from the start."""
    every = plans.filter("start_date <= end_date").withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    on = F.expr("contains(days, cast(weekday(date) + 1 as string)) and (datediff(date, start_date) div 7) % coalesce(frequency, 1) = 0")
    return every.filter(on)


def routes(flights: DataFrame) -> DataFrame:
    """(origin, dest, companies, flights): sorted sets of one airport pair.

    ``flights`` are operating designators, ``company_number``; ``companies`` are all that sell a flight: those that operate it,
    whose own designator it has, or that a duplicate designator names. Each row's few names are exploded and made distinct before the sets
    are made: a task keeps each name of a pair once, however many flights it has, and sorts none of them.
    """
    names = F.array_union(F.array("op_company", "company"), F.coalesce("duplicates", F.array().cast("array<string>")))
    sold = F.transform(names, lambda c: F.struct(F.lit(True).alias("sells"), c.alias("x")))
    own = F.array(F.struct(F.lit(False).alias("sells"), F.concat_ws("_", "op_company", "op_number").alias("x")))
    one = flights.select("origin", "dest", F.explode(F.concat(sold, own)).alias("t")).select("origin", "dest", "t.sells", "t.x").distinct()
    of = lambda sells: F.array_sort(F.collect_list(F.when(F.col("sells") == sells, F.col("x"))))  # noqa: E731; Spark would drop distinct() before a set
    return one.groupBy("origin", "dest").agg(of(True).alias("companies"), of(False).alias("flights"))


def merge_flights(flights: DataFrame) -> DataFrame:
    """One row per (company, number, origin, dest, date): the last departure wins, then the last arrival; ``n`` counts rows."""
    key = ["company", "number", "origin", "dest", F.to_date("dep").alias("date")]
    return flights.groupBy(*key).agg(F.max(F.struct("dep", "arr", "block")).alias("x"), F.count("*").alias("n")).select("company", "number", "origin", "dest", "date", "x.dep", "x.arr", "x.block", "n")
