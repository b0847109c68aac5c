"""Write operators as functions from state to state (``Catalog.commit`` makes the result current).

All of them meet the state by one join on the album's key; a batch is reduced
to one row a key first.  Times are passed in (``as_of``), never read from the
clock.  New surrogate ids go on from the largest one in the order of the
batch; only their order means anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import file_extension
from ..sources.schema import ALBUM_KEY, ALBUMS, FILES, conform
from .ordered import placed

MAX_ERROR = 500


def _time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def numbered(rows: DataFrame, order: list[str], first: Column) -> DataFrame:
    """``id`` = first, first + 1, ... in the order of the columns ``order``."""
    return placed(rows, order, "_at").withColumn("id", (first + F.col("_at")).cast("long")).drop("_at")


def next_id(state: DataFrame) -> Column:
    return state.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("n")).scalar()


def last_cards(cards: DataFrame, order: list[str]) -> DataFrame:
    """One row an album from discovery cards applied in order: the last title and count, the last thumb that is one."""
    at = F.struct(*order)
    return cards.filter(F.col(ALBUM_KEY).isNotNull()).groupBy(ALBUM_KEY).agg(
        F.max_by(F.coalesce("title", F.lit("")), at).alias("title"),
        F.max_by(F.coalesce("file_count", F.lit(0)), at).cast("long").alias("file_count"),
        F.coalesce(F.max_by("thumb", F.when(F.col("thumb") != "", at)), F.lit("")).alias("thumb"),
        *[F.min_by(o, at).alias(f"_first_{i}") for i, o in enumerate(order)],
    )


def upsert_discovered(albums: DataFrame, cards: DataFrame, as_of: str, order: list[str]) -> DataFrame:
    """Cards into albums: title and count are overwritten, a thumb only by a thumb, times of known albums stay."""
    batch = last_cards(cards, order)
    old = albums.select(*[F.col(c).alias(f"o_{c}") for c in albums.columns])
    joined = old.join(batch, F.col(f"o_{ALBUM_KEY}") == F.col(ALBUM_KEY), "full_outer")
    hit = F.col(ALBUM_KEY).isNotNull()
    known = joined.filter(F.col("o_id").isNotNull()).select(
        F.col("o_id").alias("id"), F.col(f"o_{ALBUM_KEY}").alias(ALBUM_KEY),
        F.when(hit, F.col("title")).otherwise(F.col("o_title")).alias("title"),
        F.when(hit, F.col("file_count")).otherwise(F.col("o_file_count")).alias("file_count"),
        F.when(hit & (F.col("thumb") != ""), F.col("thumb")).otherwise(F.col("o_thumb")).alias("thumb"),
        *[F.col(f"o_{c}").alias(c) for c in ALBUMS.names[5:]],
    )
    firsts = [f"_first_{i}" for i in range(len(order))]
    fresh = joined.filter(F.col("o_id").isNull()).select(ALBUM_KEY, "title", "file_count", "thumb", *firsts)
    fresh = numbered(fresh, firsts, next_id(albums)).withColumns({"discovered_at": _time(as_of), "updated_at": _time(as_of)})
    return known.unionByName(_new_album(fresh))


def _new_album(rows: DataFrame) -> DataFrame:
    defaults = {"title": F.lit(""), "file_count": F.lit(0), "thumb": F.lit(""), "attempts": F.lit(0), "last_error": F.lit(""), "dead": F.lit(0)}
    return conform(rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns}), ALBUMS)


def count_new(albums: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows of a batch whose album is not known (a repeated one counts each time)."""
    return cards.join(albums.select(ALBUM_KEY), ALBUM_KEY, "left_anti").agg(F.count("*").alias("new_albums"))


def set_pending(albums: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Enqueues album ids (columns: key, pos): known ones are reset, new ones begin; null and '' are dropped."""
    batch = ids.filter(F.col(ALBUM_KEY) != "").groupBy(ALBUM_KEY).agg(F.min("pos").alias("_pos"))
    joined = albums.join(batch, ALBUM_KEY, "left")
    hit = F.col("_pos").isNotNull()
    known = joined.withColumns({
        "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "dead": F.when(hit, 0).otherwise(F.col("dead")),
        "last_error": F.when(hit, "").otherwise(F.col("last_error")), "indexed_at": F.when(~hit, F.col("indexed_at")),
        "updated_at": F.when(hit, _time(as_of)).otherwise(F.col("updated_at")),
    })
    fresh = batch.join(albums.select(ALBUM_KEY), ALBUM_KEY, "left_anti")
    fresh = numbered(fresh, ["_pos"], next_id(albums)).withColumns({"discovered_at": _time(as_of), "updated_at": _time(as_of)})
    return conform(known, ALBUMS).unionByName(_new_album(fresh))


def split_duplicates(new_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of sound albums, albums that hold a file id twice): the latter are not written, each on its own."""
    twice = new_files.groupBy("album_id", "file_id").agg(F.count("*").alias("n")).filter("n > 1").select("album_id").distinct()
    return new_files.join(twice, "album_id", "left_anti"), twice


def replace_files(files: DataFrame, new_files: DataFrame, replaced: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Files of the replaced albums (column album_id) go, the new ones come; ids go on in batch order."""
    kept = files.join(replaced.select("album_id").distinct(), "album_id", "left_anti")
    filled = new_files.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in ("search_name", "storage", "slug", "mime", "media") if c in new_files.columns},
        "size": F.coalesce("size", F.lit(0)),
        "extension": F.coalesce(F.nullif("extension", F.lit("")), file_extension("search_name")),
    })
    fresh = numbered(filled.drop("id"), list(order), next_id(files))
    return conform(kept, FILES).unionByName(conform(fresh, FILES))


def replace_albums(albums: DataFrame, parsed: DataFrame, counts: DataFrame, as_of: str) -> DataFrame:
    """Albums after their files were replaced.  parsed: key, title, thumb, pos; counts: album_id, n.

    A known album takes the number of files, a new one keeps 0 until it is
    replaced again.
    """
    batch = parsed.join(counts.select(F.col("album_id").alias(ALBUM_KEY), "n"), ALBUM_KEY, "left").select(
        ALBUM_KEY, F.coalesce("title", F.lit("")).alias("n_title"), F.coalesce("thumb", F.lit("")).alias("n_thumb"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "pos"
    )
    joined = albums.join(batch, ALBUM_KEY, "left")
    hit = F.col("pos").isNotNull()
    new = lambda value, column: F.when(hit, value).otherwise(F.col(column))
    known = joined.withColumns({
        "title": new(F.col("n_title"), "title"), "file_count": new(F.col("n"), "file_count"),
        "thumb": F.when(hit & (F.col("n_thumb") != ""), F.col("n_thumb")).otherwise(F.col("thumb")),
        "indexed_at": new(_time(as_of), "indexed_at"), "updated_at": new(_time(as_of), "updated_at"),
        "attempts": new(F.lit(0), "attempts"), "last_error": new(F.lit(""), "last_error"), "dead": new(F.lit(0), "dead"),
    })
    fresh = batch.join(albums.select(ALBUM_KEY), ALBUM_KEY, "left_anti").select(ALBUM_KEY, F.col("n_title").alias("title"), F.col("n_thumb").alias("thumb"), "pos")
    fresh = numbered(fresh, ["pos"], next_id(albums)).withColumns({c: _time(as_of) for c in ("discovered_at", "updated_at", "indexed_at")})
    return conform(known, ALBUMS).unionByName(_new_album(fresh))


def mark_errors(albums: DataFrame, errors: DataFrame, as_of: str) -> DataFrame:
    """One failure an album (key, message, dead): unknown albums are left alone, indexed_at never changes."""
    batch = errors.select(ALBUM_KEY, F.substring(F.coalesce("message", F.lit("")), 1, MAX_ERROR).alias("_error"), F.col("dead").alias("_dead"))
    hit = F.col("_error").isNotNull()
    out = albums.join(batch, ALBUM_KEY, "left").withColumns({
        "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "last_error": F.coalesce("_error", "last_error"), "updated_at": F.when(hit, _time(as_of)).otherwise(F.col("updated_at")),
        "dead": F.when(F.coalesce("_dead", F.lit(False)), 1).otherwise(F.col("dead")),
    })
    return conform(out, ALBUMS)


def apply_outcomes(albums: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A whole log of fetch outcomes (status, message, fetched_at, outcome_id) in the order of fetching, however it arrived.

    What a success resets is taken from the last one; failures after it count.
    """
    log = outcomes.dropDuplicates([c for c in outcomes.columns if c != "outcome_id" and c != "arrived_at"])
    at = F.struct("fetched_at", "outcome_id")
    last_ok = log.filter("status = 'ok'").groupBy(ALBUM_KEY).agg(F.max(at).alias("_ok"), F.max_by("file_rows", at).alias("_rows"))
    since = log.join(last_ok.select(ALBUM_KEY, "_ok"), ALBUM_KEY, "left").filter((F.col("status") != "ok") & (F.col("_ok").isNull() | (at > F.col("_ok"))))
    failed = since.groupBy(ALBUM_KEY).agg(
        F.count("*").cast("int").alias("_fails"), F.max_by(F.substring(F.coalesce("message", F.lit("")), 1, MAX_ERROR), at).alias("_error"),
        F.max((F.col("status") == "dead").cast("int")).alias("_died"), F.max("fetched_at").alias("_failed_at"),
    )
    ok = F.col("_ok").isNotNull()
    out = albums.join(last_ok, ALBUM_KEY, "left").join(failed, ALBUM_KEY, "left").withColumns({
        "attempts": (F.when(ok, 0).otherwise(F.col("attempts")) + F.coalesce("_fails", F.lit(0))).cast("int"),
        "last_error": F.coalesce("_error", F.when(ok, "").otherwise(F.col("last_error"))),
        "dead": F.greatest(F.when(ok, 0).otherwise(F.col("dead")), F.coalesce("_died", F.lit(0))).cast("int"),
        "file_count": F.when(ok, F.coalesce("_rows", F.lit(0))).otherwise(F.col("file_count")),
        "indexed_at": F.coalesce("_ok.fetched_at", "indexed_at"),
        "updated_at": F.coalesce("_failed_at", "_ok.fetched_at", "updated_at"),
    })
    return conform(out, ALBUMS)


def delete_albums(albums: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums (by key) and, with them, their files."""
    keys = gone.select(ALBUM_KEY).distinct()
    return albums.join(keys, ALBUM_KEY, "left_anti"), files.join(keys.withColumnRenamed(ALBUM_KEY, "album_id"), "album_id", "left_anti")


def backfill_extension(files: DataFrame) -> DataFrame:
    """Derives the extension where it is missing."""
    return files.withColumn("extension", F.when(F.coalesce("extension", F.lit("")) == "", file_extension("search_name")).otherwise(F.col("extension")))


def set_meta(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Key/value upsert."""
    return meta.join(entries.select("key"), "key", "left_anti").select("key", "value").unionByName(entries.select("key", "value"))
