"""The stored search index: files sorted by their folded name, and trigram postings, kept up to date by deltas.

Layout of an index folder: ``names/version=<n>`` (all columns of files and the
folded ones, sorted by the leading one), ``postings/version=<n>/lead=<k>``
(gram, bucket, id) and ``gone/version=<n>`` (ids whose earlier names and
postings no longer hold).  A delta is a version of its own, so nothing is
rewritten; a search reads the partitions of its grams, or the row groups that
can hold its prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fold, trigrams
from ..plans import language as L
from .search import file_hits

LEADS = 64
BUCKETS = 256


def with_folded(files: DataFrame) -> DataFrame:
    """Files with what the search compares by: all their names folded in one text, and the name that a prefix is sought in."""
    return files.withColumns({L.NAMES: fold(L.names_of()), L.LEADING: fold("search_name")})


def postings(files: DataFrame, columns: tuple[str, ...] = L.SEARCHED) -> DataFrame:
    """lead, gram, bucket, id: which files hold a trigram in one of their names.

    A gram that every name holds is spread over buckets by id, so no task gets all of it.
    """
    grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.coalesce(c, F.lit(""))) for c in columns])))
    each = files.select("id", F.explode(grams).alias("gram"))
    return each.select(_lead(F.col("gram")).alias("lead"), "gram", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"), "id")


def _lead(gram):
    return F.pmod(F.xxhash64(gram), F.lit(LEADS)).cast("int")


def write(files: DataFrame, path: str) -> None:
    """The index of all files, as version 0."""
    add(files, path, 0)


def add(files: DataFrame, path: str, version: int, gone: DataFrame | None = None) -> None:
    """New or changed files as a version; ``gone`` (id): files that went or changed.

    Run again, a version overwrites itself.
    """
    gone = files.select("id").limit(0) if gone is None else gone.select("id")
    gone.write.mode("overwrite").parquet(f"{path}/gone/version={version}")
    sorted_names = with_folded(files).repartitionByRange(L.LEADING, "id").sortWithinPartitions(L.LEADING, "id")
    sorted_names.write.mode("overwrite").parquet(f"{path}/names/version={version}")
    # each lead in a few pieces of buckets: one file for each, none of a whole hot gram
    spread = postings(files).repartition("lead", F.col("bucket") % 8).sortWithinPartitions("lead", "gram")
    spread.write.mode("overwrite").partitionBy("lead").parquet(f"{path}/postings/version={version}")


def _live(rows: DataFrame, path: str) -> DataFrame:
    """Rows (id, version) that no later version has taken back."""
    gone = rows.sparkSession.read.schema("id long, version int").parquet(f"{path}/gone").groupBy("id").agg(F.max("version").alias("since"))
    return rows.join(gone, "id", "left").filter(F.col("since").isNull() | (F.col("version") >= F.col("since"))).drop("since")


def candidates(spark: SparkSession, path: str, q: str) -> DataFrame:
    """Ids of files that hold all trigrams of a query (a superset of the answer for one-spelling queries)."""
    wanted = sorted({g.lower() for g in L.query_grams(q) or []})
    held = spark.read.schema("gram string, bucket int, id long, version int, lead int").parquet(f"{path}/postings")
    grams = spark.createDataFrame([(g,) for g in wanted], "gram string")
    leads = sorted({r[0] for r in grams.select(_lead(F.col("gram"))).collect()})  # of one query's grams
    held = held.filter(F.col("lead").isin(*leads) & F.col("gram").isin(*wanted))
    full = _live(held, path).groupBy("bucket", "id").agg(F.count_distinct("gram").alias("n"))
    return full.filter(F.col("n") == len(wanted)).select("id")


def names(spark: SparkSession, path: str) -> DataFrame:
    """The stored files with their folded columns, as the last version has them."""
    return _live(spark.read.parquet(f"{path}/names"), path).drop("version")


def search(spark: SparkSession, path: str, q: str, columns: list[str] | None = None) -> DataFrame:
    """File search over the stored index: a prefix by the sorted name, terms by the postings and then exactly."""
    files = names(spark, path)
    if L.mode_of(q) == "fts" and all(len(L.variants(t)) == 1 for t in L.terms(q)):
        files = files.join(candidates(spark, path, q), "id", "left_semi")
    return file_hits(files, q, columns=columns)
