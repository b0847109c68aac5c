"""Percentiles per group of very large numeric columns, from cumulative frequencies.

Values become cells of ``bits`` significant bits (exact below 2**bits), so a
group has at most ``64 * 2**bits`` cells whatever its rows, and a percentile
is known up to a relative error below ``2**(1 - bits)``.  The group-cell
counts are the summary: summaries of slices or days combine by adding counts.

For the percentiles the cells of each group are cut into value ranges (their
leading ``RANGE_BITS`` bits: a fixed, order-preserving rule, so a group with a
third of all rows is spread like any other), counts run up inside each range,
the totals of the ranges before it are added, and the first cell that reaches
a target rank is the answer.

Defined results: null values are left out, a group of nulls only has no row;
null and '' are groups of their own; rank ``max(1, ceil(p * n))`` is meant, so
p = 0 gives the smallest value; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 11
RANGE_BITS = 5
PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.9, 0.99)


def _shift(magnitude: Column, bits: int) -> Column:
    return F.greatest(F.length(F.bin(magnitude)) - F.lit(bits), F.lit(0)).cast("int")


def _magnitude(value: Column) -> Column:
    """The absolute value; that of the smallest BIGINT, which has none, is taken as the greatest BIGINT."""
    return F.abs(F.greatest(value, F.lit(-(2**63) + 1)))


def cell(value: Column, bits: int = BITS) -> tuple[Column, Column]:
    """(lowest, highest) value of the cell of an integer value; its order is that of the values."""
    magnitude = _magnitude(value)
    low = F.call_function("shiftleft", F.call_function("shiftright", magnitude, _shift(magnitude, bits)), _shift(magnitude, bits))
    high = low + (F.call_function("shiftleft", F.lit(1).cast("long"), _shift(magnitude, bits)) - 1)
    return F.when(value < 0, -high).otherwise(low), F.when(value < 0, -low).otherwise(high)


def summary(df: DataFrame, value: str, groups: list[str], bits: int = BITS) -> DataFrame:
    """Group-cell counts of a slice: field_name, group_value, cell, n.  One pass and one pre-aggregated shuffle for all groupings."""
    low, _ = cell(F.col("_value"), bits)
    return (
        df.select(F.col(value).cast("long").alias("_value"), *[F.col(g).cast("string").alias(g) for g in groups])
        .filter(F.col("_value").isNotNull())
        .withColumn("cell", low)
        .withColumn("x", F.explode(F.array(*[F.struct(F.lit(g).alias("field_name"), F.col(g).alias("group_value")) for g in groups])))
        .groupBy("x.field_name", "x.group_value", "cell")
        .agg(F.count("*").alias("n"))
    )


def combine(*summaries: DataFrame) -> DataFrame:
    """The summary of all slices together."""
    return reduce(DataFrame.unionByName, summaries).groupBy("field_name", "group_value", "cell").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, ps: tuple[float, ...] = PERCENTILES, bits: int = BITS) -> DataFrame:
    """field_name, group_value, p, n, value_low, value_high: the true percentile lies in between, both ends included."""
    leading, _ = cell(F.col("cell"), min(RANGE_BITS, bits))
    keyed = counts.select(
        F.col("field_name"), F.coalesce(F.concat(F.lit("="), "group_value"), F.lit("null")).alias("key"), "cell", "n", leading.alias("range")
    )
    of_range = Window.partitionBy("field_name", "key", "range")
    inside = of_range.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    # both sides of the join below come from this one shuffle
    running = keyed.withColumns({"in_range": F.sum("n").over(inside), "range_n": F.sum("n").over(of_range)})
    # at most 64 * 2**RANGE_BITS rows a group
    before = Window.partitionBy("field_name", "key").orderBy("range")
    offsets = running.filter(F.col("in_range") == F.col("range_n")).select(
        "field_name", "key", "range",
        (F.sum("range_n").over(before) - F.col("range_n")).alias("offset"),
        F.sum("range_n").over(Window.partitionBy("field_name", "key")).alias("total"),
    )
    p = F.explode(F.array(*[F.lit(float(x)) for x in ps])).alias("p")
    placed = running.join(offsets, ["field_name", "key", "range"]).select("field_name", "key", "cell", "n", "total", (F.col("offset") + F.col("in_range")).alias("reached"), p)
    target = F.greatest(F.lit(1).cast("double"), F.ceil(F.col("p") * F.col("total")).cast("double"))
    found = placed.filter((F.col("reached") >= target) & (F.col("reached") - F.col("n") < target))
    magnitude = _magnitude(F.col("cell"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), _shift(magnitude, bits)) - 1
    # a negative cell is named by its lowest value, whose last bits are all set, so its width is the same rule
    return found.select(
        "field_name", F.when(F.col("key") == "null", F.lit(None).cast("string")).otherwise(F.expr("substring(key, 2)")).alias("group_value"),
        "p", F.col("total").alias("n"), F.col("cell").alias("value_low"), (F.col("cell") + width).alias("value_high"),
    )
