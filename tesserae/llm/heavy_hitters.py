"""Most frequent items of very large columns, by lossy counting.

Each partition keeps one table of entries (item, count, delta) per field.  Its
rows come in buckets of ``ceil(1 / epsilon)``; at the end of bucket b every
entry with ``count + delta <= b`` goes, so an entry's true count is between
``count`` and ``count + delta`` and a missing item occurred at most b times.
Partition summaries merge by adding counts and adding the possible undercounts,
those of the partitions that hold no entry included, which gives a guaranteed
interval per item.  Memory is bounded by ``(2 / epsilon) * log(epsilon * n / 2)``
entries a field and partition (Manku and Motwani, 2002) and ``2 / epsilon`` a
field once they are merged, whatever the number of distinct values.

Defined results: null and '' count as rows but are no items; an empty table
gives no rows; values count exactly as stored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_table

EPSILON = 0.0005


class LossyCounter:
    """Lossy counting of one column of one partition."""

    def __init__(self, epsilon: float) -> None:
        self.width = max(1, round(1 / epsilon))
        self.entries: dict[str, list[int]] = {}
        self.rows, self.bucket = 0, 1

    def add(self, column: pa.Array) -> None:
        at = 0
        while at < len(column):
            take = min(len(column) - at, self.width * self.bucket - self.rows)
            counted = pc.value_counts(column.slice(at, take))
            entries, delta = self.entries, self.bucket - 1
            for item, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True):
                if not item:
                    continue
                if (entry := entries.get(item)) is not None:
                    entry[0] += n
                else:
                    entries[item] = [n, delta]
            at += take
            self.rows += take
            if self.rows == self.width * self.bucket:
                self.entries = {k: e for k, e in entries.items() if e[0] + e[1] > self.bucket}
                self.bucket += 1

    def missed(self) -> int:
        """How often an item without an entry can have occurred."""
        return self.bucket - 1


_SUMMARY = "field_name string, item string, n long, slack long, missed long, row_count long"


def summarize(batches: Iterable[pa.RecordBatch], epsilon: float) -> Iterator[pa.RecordBatch]:
    """Per partition and field: a head row (item null) and a row per entry."""
    counters: dict[str, LossyCounter] = {}
    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            counters.setdefault(name, LossyCounter(epsilon)).add(column)
    for name, c in counters.items():
        items = list(c.entries)
        n = [c.entries[i][0] for i in items]
        # slack: what this partition adds less to the possible undercount because it holds the entry
        slack = [c.missed() - min(c.entries[i][1], c.missed()) for i in items]
        none = [None] * len(items)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in (
                ([name] * (len(items) + 1), pa.string()), ([None, *items], pa.string()), ([None, *n], pa.int64()),
                ([None, *slack], pa.int64()), ([c.missed(), *none], pa.int64()), ([c.rows, *none], pa.int64()))],
            names=["field_name", "item", "n", "slack", "missed", "row_count"],
        )


def summaries(df: DataFrame, fields: list[str], epsilon: float = EPSILON) -> DataFrame:
    """One summary per partition of the text columns ``fields``: small rows that can be kept and merged later.

    Partitions count at half of ``epsilon``; the other half is left for the pruning of merged summaries.
    """
    return df.select(*fields).mapInArrow(lambda batches: summarize(batches, epsilon / 2), _SUMMARY)


def _kept(df: DataFrame, fields: list[str], epsilon: float) -> DataFrame:
    """The summaries in the shared folder: merging reads them twice, the rows are counted once."""
    return shared_table(summaries(df, fields, epsilon), "summaries")


def merge(parts: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Merged summaries (any number of them, of any slices): field_name, item, count_low, count_high, row_count.

    Counts add up task by task before they meet.  An entry that cannot have
    occurred more than ``epsilon * row_count`` times is pruned, so at most
    ``2 / epsilon`` entries a field are left, however many summaries there
    were, and an item without an entry occurred at most ``epsilon * row_count``
    times.  The totals of a field have its name and a null item on their way.
    """
    merged = parts.groupBy("field_name", "item").agg(
        F.sum("n").alias("n"), F.sum("slack").alias("slack"), F.sum("missed").alias("missed"), F.sum("row_count").alias("row_count")
    )
    heads = merged.filter(F.col("item").isNull()).select(
        F.col("field_name"), F.col("missed").alias("all_missed"), F.col("row_count").alias("all_rows")
    )
    # one row for each field that was asked for
    return (
        merged.filter(F.col("item").isNotNull())
        .join(F.broadcast(heads), "field_name")
        .select(
            "field_name", "item", F.col("n").alias("count_low"),
            (F.col("n") + F.col("all_missed") - F.col("slack")).alias("count_high"), F.col("all_rows").alias("row_count"),
        )
        .filter(F.col("count_high") > F.col("row_count") * F.lit(epsilon))
    )


def frequent(df: DataFrame, fields: list[str], share: float, epsilon: float = EPSILON) -> DataFrame:
    """All items whose guaranteed interval reaches ``share`` of the rows: none above it is missing."""
    if not epsilon < share:
        raise ValueError("epsilon must be smaller than share")
    return merge(_kept(df, fields, epsilon), epsilon).filter(F.col("count_high") >= F.col("row_count") * F.lit(share))


def top(df: DataFrame, fields: list[str], k: int, epsilon: float = EPSILON) -> DataFrame:
    """The k items of each field with the most certain occurrences, ties by the smaller item.

    guaranteed: no item outside the k can have occurred more often.
    """
    merged = merge(_kept(df, fields, epsilon), epsilon)
    # at most 2 / epsilon rows a field
    best = Window.partitionBy("field_name").orderBy(F.desc("count_low"), "item")
    ranked = merged.withColumn("rank", F.row_number().over(best))
    rest = ranked.filter(F.col("rank") > k).groupBy("field_name").agg(F.max("count_high").alias("rest"))
    return (
        ranked.filter(F.col("rank") <= k)
        .join(F.broadcast(rest), "field_name", "left")
        .select("field_name", "item", "rank", "count_low", "count_high", ((F.col("count_low") >= F.coalesce("rest", F.lit(0))) & (F.col("count_low") >= F.col("row_count") * F.lit(epsilon))).alias("guaranteed"))
    )


def exactly(df: DataFrame, fields: list[str], candidates: DataFrame, share: float) -> DataFrame:
    """The candidates that really are held by ``share`` of all rows: field_name, item, n.

    ``candidates`` come from :func:`frequent`; there are at most
    ``1 / (share - epsilon)`` a field, so they are broadcast.
    """
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("item")) for f in fields])).alias("x")
    ).select("x.*")
    counted = (
        stacked.join(F.broadcast(candidates.select("field_name", "item", "row_count")), ["field_name", "item"])
        .groupBy("field_name", "item")
        .agg(F.count("*").alias("n"), F.max("row_count").alias("row_count"))
    )
    return counted.filter(F.col("n") >= F.col("row_count") * F.lit(share)).select("field_name", "item", "n")
