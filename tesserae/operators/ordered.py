"""Positions and runs in one order over all rows, without a task that sees all of them.

Rows are cut into ranges of the order, which are written to the shared folder
with their place inside the range; the driver adds up one small row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_table

_IN_RANGE = 33  # monotonically_increasing_id: range number above, place inside the range below


def ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_range`` and ``_place``: ranges in the given order, and the place inside each, from 0."""
    spread = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    return shared_table(spread, "ranges").withColumns({"_range": F.shiftright("_n", _IN_RANGE), "_place": F.col("_n").bitwiseAND((1 << _IN_RANGE) - 1)}).drop("_n")


def _carried(rows: DataFrame, carry: dict[int, int], name: str) -> DataFrame:
    """One number a range, joined by broadcast: there is a row for each range only."""
    schema = f"_range long, `{name}` long"
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(sorted(carry.items()), schema)), "_range")


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their position in the order, from 0, as column ``name``; which of equal rows is first is left open."""
    ranged = ranges(rows, order)
    before, carry = 0, {}
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        carry[r["_range"]] = before
        before += r["count"]
    return _carried(ranged, carry, "_before").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def streaks(rows: DataFrame, order: list[str], counts: Column, ends: Column, name: str) -> DataFrame:
    """``rows`` with the number of rows that count, up to and with each, since the last row that ends a streak."""
    ranged = ranges(rows.withColumns({"_counts": F.coalesce(counts, F.lit(False)).cast("long"), "_ends": F.coalesce(ends, F.lit(False))}), order)
    up_to = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumn("_so_far", F.sum("_counts").over(up_to))
    # what had been counted when the last streak of this range ended; null before the first end
    counted = counted.withColumn("_ended_at", F.max(F.when(F.col("_ends"), F.col("_so_far"))).over(up_to))
    behind, carry = 0, {}
    totals = counted.groupBy("_range").agg(F.max("_so_far").alias("n"), F.max("_ended_at").alias("ended"))
    for r in totals.orderBy("_range").collect():
        carry[r["_range"]] = behind
        behind = r["n"] - r["ended"] if r["ended"] is not None else behind + r["n"]
    joined = _carried(counted, carry, "_behind")
    streak = F.col("_so_far") - F.coalesce(F.col("_ended_at"), -F.col("_behind"))
    return joined.withColumn(name, streak).drop("_range", "_place", "_counts", "_ends", "_so_far", "_ended_at", "_behind")
