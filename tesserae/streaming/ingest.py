"""Continuous ingest: landed pages and logs as streams, merged batch by batch into the catalog.

Checkpoints replace a lock, resume and retry logic: a batch that was not
committed is run again, and one that was committed before its checkpoint was
written is known by its number, which the catalog keeps with the state.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge, state
from ..sources import pages as P
from ..sources.schema import ALBUM_KEY, Catalog


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet landing folder as a stream; rows without a time of arrival take that of their file."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream if "arrived_at" in stream.columns else stream.withColumn("arrived_at", F.col("_metadata.file_modification_time"))


def _now(batch: DataFrame) -> str:
    return str(batch.sparkSession.sql("SELECT current_timestamp()").first()[0])


def commit_cards(catalog: Catalog, as_of: str | None = None, stream: str = "cards") -> Callable[[DataFrame, int], None]:
    """Merges a batch of discovery cards (key, title, file_count, thumb, seen_at, card_id), once."""

    def run(batch: DataFrame, number: int) -> None:
        at = as_of or _now(batch)
        catalog.update(lambda t: {"albums": merge.upsert_discovered(t["albums"], batch, at, ["seen_at", "card_id"])}, (stream, number))

    return run


def commit_pages(catalog: Catalog, as_of: str | None = None, stream: str = "pages") -> Callable[[DataFrame, int], None]:
    """Parses a batch of album pages (key, html, arrived_at) and replaces their files, once.

    Pages without a complete file array, and albums that hold a file id
    twice, are marked as errors, each on its own; of several pages of one
    album the latest counts (of those that arrived together the greatest in
    binary order).
    """

    def run(batch: DataFrame, number: int) -> None:
        at = as_of or _now(batch)
        latest = batch.groupBy(ALBUM_KEY).agg(F.max_by("html", F.struct("arrived_at", "html")).alias("html"))
        catalog.update(lambda t: dict(zip(("albums", "files"), apply_pages(t["albums"], t["files"], latest, at), strict=True)), (stream, number))

    return run


def apply_pages(albums: DataFrame, files: DataFrame, pages: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(albums, files) after a batch of album pages."""
    parsed = P.album_pages(pages)
    rows = P.album_files(parsed)
    sound, twice = merge.split_duplicates(rows)
    good = parsed.filter("blob AND NOT parse_error").join(twice.withColumnRenamed("album_id", ALBUM_KEY), ALBUM_KEY, "left_anti")
    counts = sound.groupBy("album_id").agg(F.count("*").alias("n"))
    new_albums = merge.replace_albums(albums, good.select(ALBUM_KEY, "title", "thumb", F.col(ALBUM_KEY).alias("pos")), counts, as_of)
    new_files = merge.replace_files(files, sound, good.select(F.col(ALBUM_KEY).alias("album_id")), ["album_id", "pos"])
    no_files = parsed.filter("parse_error OR NOT blob").select(ALBUM_KEY, F.lit("the page holds no complete list of files").alias("message"))
    repeated = twice.select(F.col("album_id").alias(ALBUM_KEY), F.lit("the page lists a file id more than once").alias("message"))
    failed = no_files.unionByName(repeated).withColumn("dead", F.lit(False))
    return merge.mark_errors(new_albums, failed, as_of), new_files


def follow(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "24 hours") -> StreamingQuery:
    """Runs a commit over a stream: all that is there (``once``), or at an interval."""
    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def upsert_windows(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps the last state of every window, open ones too: one Parquet folder a batch in update mode, named by its number.

    A batch that is run again overwrites its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{number}")

    return run


def windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows that :func:`upsert_windows` has kept, each as its last batch left it."""
    stored = spark.read.schema("start timestamp, end timestamp, cards long, batch long").parquet(f"{path}/*")
    return stored.groupBy("start", "end").agg(F.max_by("cards", "batch").alias("cards"))


def arrivals(cards: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Cards seen per window of event time, late ones within the watermark included, repeated rows once.

    In append mode a window is written once it is closed, so those of the last ``late`` are still missing; in update
    mode (:func:`upsert_windows`) every window is there as it stands.
    """
    once = cards.withWatermark("seen_at", late).dropDuplicatesWithinWatermark([ALBUM_KEY, "page_no", "seen_at"])
    return once.groupBy(F.window("seen_at", width)).agg(F.count("*").alias("cards")).select("window.start", "window.end", "cards")


def sync(catalog: Catalog, cards: DataFrame, pages: DataFrame, checkpoint: str, as_of: str | None = None) -> dict[str, int]:
    """One cycle: all landed cards, then all landed pages; how many albums, indexed albums and files there are then.

    Cycles may meet: the catalog's commits start again where another was first.
    """
    follow(cards, commit_cards(catalog, as_of), f"{checkpoint}/cards").awaitTermination()
    follow(pages, commit_pages(catalog, as_of), f"{checkpoint}/pages").awaitTermination()
    found = state.stats(catalog.read("albums"), catalog.read("files")).first()
    return {c: found[c] for c in ("albums_total", "albums_indexed", "files")}


def sync_every(cycle: Callable[[], object], hours: float, cycles: int | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
    """Runs a cycle again and again, from start to start of ``hours``; a cycle that fails is left to the next one."""
    done = 0
    while cycles is None or done < cycles:
        began, done = clock(), done + 1
        try:
            cycle()
        except Exception:
            logging.getLogger(__name__).exception("the cycle failed")
        if cycles is None or done < cycles:
            sleep(max(0.0, max(0.0, hours) * 3600 - (clock() - began)))
