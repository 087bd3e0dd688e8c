"""What the lines of a file owe to those before them, a large file dealt over many tasks.

Lines are numbered by a rising long, not necessarily without gaps. A *stretch* holds the lines of 2**STRETCH_BITS numbers.
Within a stretch a window tells; what comes from the stretches before is carried by a table of one row per stretch. So no
task holds more than a stretch of lines, or that small table. The more lines, the more tasks stretches are dealt over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.sources.tables import dealt

STRETCH_BITS = 16


def _stretched(lines: DataFrame, order: str) -> DataFrame:
    return lines.withColumn("_stretch", F.shiftright(F.col(order).cast("long"), STRETCH_BITS))


def _with_carry(lines: DataFrame, keys: list[str], own: Column, over_stretches, rows: int) -> DataFrame:
    """``lines`` with ``_carry``: ``over_stretches`` of ``own``, an aggregate of each stretch, over the stretches of the file before."""
    before = Window.partitionBy(*keys).orderBy("_stretch")
    table = lines.groupBy(*keys, "_stretch").agg(own.alias("_own")).select(*keys, "_stretch", over_stretches("_own", before).alias("_carry"))
    table = table.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_stretch").alias("_at"), "_carry")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys], F.col("_stretch") == F.col("_at"))
    out = dealt(lines, rows, *keys, "_stretch").join(table, same).drop("_at", *["_k_" + k for k in keys])
    return dealt(out, rows, *keys, "_stretch") if keys else out  # a join of keys that may be null deals by other expressions


def running(lines: DataFrame, keys: list[str], order: str, value: str, name: str, how: str = "sum", rows: int | None = None) -> DataFrame:
    """``lines`` with ``name``: the sum, or with ``how="max"`` the largest, of ``value`` in the file up to each line; nulls count as none.

    ``rows`` is how many lines there are, if known; else they are counted.
    """
    f, join = (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how == "sum" else (F.max, F.greatest)
    x = _with_carry(_stretched(lines, order), keys, f(value), lambda own, w: f(own).over(w.rowsBetween(Window.unboundedPreceding, -1)), lines.count() if rows is None else rows)
    here = f(value).over(Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(name, join(here, F.col("_carry"))).drop("_carry", "_stretch")


def previous(lines: DataFrame, keys: list[str], order: str, fields: list[str], name: str, rows: int | None = None) -> DataFrame:
    """``lines`` with ``name``, a struct of ``fields`` of the line before in the file; null for the first. ``rows`` as in ``running``."""
    x = _with_carry(_stretched(lines, order), keys, F.max_by(F.struct(*fields), F.col(order)), lambda own, w: F.lag(own).over(w), lines.count() if rows is None else rows)
    here = F.lag(F.struct(*fields)).over(Window.partitionBy(*keys, "_stretch").orderBy(order))
    return x.withColumn(name, F.coalesce(here, F.col("_carry"))).drop("_carry", "_stretch")
