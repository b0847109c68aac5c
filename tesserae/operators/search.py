"""Read operators over files and albums."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trigrams
from ..plans import language as L
from ..sources.schema import ALBUM_KEY

COUNT_CAP = 50_000
#: A page of at most so many rows is broadcast to the albums; a larger one joins as Spark sees fit.
BROADCAST_ROWS = 10_000
FILE_COLUMNS = ["id", "album_id", "file_id", "search_name", "storage", "slug", "mime", "media", "extension", "size", "uploaded_at"]


def file_hits(files: DataFrame, q: str = "", media: str | None = None, extension: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """All files that a query and its filters admit, without order (pruned to ``columns``)."""
    mode = L.mode_of(q)
    wanted = [c for c in (L.media_filter(media), L.extension_filter(extension)) if c is not None]
    stored = {L.NAMES, L.LEADING} <= set(files.columns)
    if mode == "fts":
        wanted.append(L.matches(q, stored))
    elif mode == "prefix":
        wanted.append(L.starts(q, stored=stored))
    hits = files.filter(reduce(lambda a, b: a & b, wanted)) if wanted else files
    return hits.select(*(columns or FILE_COLUMNS))


def file_page(
    files: DataFrame, albums: DataFrame, q: str = "", media: str | None = None, extension: str | None = None, sort: str = "relevance",
    limit: int = 20, offset: int = 0, cursor_key: dict[str, Any] | None = None,
) -> DataFrame:
    """One page of file search: the rows are chosen first and only then meet the albums (orphans drop out)."""
    limit = max(1, limit)
    kind = L.order_kind(L.mode_of(q), sort)
    hits = file_hits(files, q, media, extension)
    if cursor_key is not None:
        hits = hits.filter(L.after(kind, cursor_key))
        offset = 0
    hits = hits.orderBy(*L.order_by(kind))
    if offset > 0:
        hits = hits.offset(offset)
    page = hits.limit(limit)
    of_albums = albums.select(F.col(ALBUM_KEY).alias("_key"), F.col("title").alias("album_title"), F.col("thumb").alias("album_thumb"))
    small = F.broadcast(page) if limit <= BROADCAST_ROWS else page
    return of_albums.join(small, F.col("_key") == F.col("album_id")).select(*FILE_COLUMNS, "album_title", "album_thumb")


def capped_total(hits: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """total (at most cap) and truncated: counting stops after cap + 1 rows."""
    counted = hits.limit(cap + 1).agg(F.count("*").alias("n"))
    return counted.select(F.least("n", F.lit(cap)).cast("long").alias("total"), (F.col("n") > cap).alias("truncated"))


def search_files(
    files: DataFrame, albums: DataFrame, q: str = "", media: str | None = None, extension: str | None = None, sort: str = "relevance",
    limit: int = 20, offset: int = 0, cursor: str | None = None, cap: int = COUNT_CAP,
) -> dict[str, Any]:
    """A page of file search with total, has_more and the cursor for the next page."""
    q, limit = q.strip(), max(1, limit)
    mode = L.mode_of(q)
    kind = L.order_kind(mode, sort)
    L.extension_filter(extension)
    context = L.context_of(q, media, extension, sort, mode)
    key = L.Cursor.decode(cursor, context).key if cursor else None
    total = capped_total(file_hits(files, q, media, extension, ["id"]), cap).first()
    page = file_page(files, albums, q, media, extension, sort, limit + 1, max(0, offset), key)
    rows = [r.asDict() for r in page.orderBy(*L.order_by(kind)).collect()]
    more, rows = len(rows) > limit, rows[:limit]
    token = None
    if more and rows:
        last = rows[-1]
        held = {"relevance": ("score", len(last["search_name"] or "")), "name": ("search_name", last["search_name"]), "size": ("size", last["size"])}
        name, value = held.get(kind, ("uploaded_at", last["uploaded_at"] and last["uploaded_at"].isoformat()))
        token = L.Cursor(context, {"id": last["id"], name: value}).encode()
    return {"query": q, "mode": mode, "total": total["total"], "truncated": total["truncated"], "has_more": more, "next_cursor": token, "results": rows}


# --------------------------------------------------------------------------- albums


def real_files(albums: DataFrame, files: DataFrame) -> DataFrame:
    """Albums with the number of files that they really hold: counts are made per task before they meet."""
    counts = files.groupBy(F.col("album_id").alias("_album")).agg(F.count("*").alias("_n"))
    return albums.join(counts, F.col(ALBUM_KEY) == F.col("_album"), "left").withColumn("real_files", F.coalesce("_n", F.lit(0)).cast("long")).drop("_album", "_n")


def _with_counts(page: DataFrame, files: DataFrame, bounded: bool) -> DataFrame:
    """real_files for a page only: files are first cut to the page's albums."""
    keys = page.select(F.col(ALBUM_KEY).alias("album_id"))
    mine = files.select("album_id").join(F.broadcast(keys) if bounded else keys, "album_id", "left_semi")
    return real_files(page, mine)


def _shown(albums: DataFrame) -> list[Column]:
    return [F.col("id"), F.col(ALBUM_KEY), F.col("title"), F.col("file_count"), F.col("thumb"), F.col("indexed_at").isNotNull().cast("int").alias("indexed"), F.col("dead")]


def _recent() -> list[Column]:
    return [F.desc_nulls_last(F.coalesce("updated_at", "discovered_at")), F.desc("id")]


def _page(rows: DataFrame, order: list[Column], limit: int, offset: int, files: DataFrame) -> DataFrame:
    page = rows.orderBy(*order)
    page = (page.offset(offset) if offset > 0 else page).limit(limit)
    # the page was one partition already; counting its files has lost the order
    return _with_counts(page, files, limit <= BROADCAST_ROWS).coalesce(1).sortWithinPartitions(*order)


def browse(albums: DataFrame, files: DataFrame, indexed: bool | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Living albums, latest change first, with real_files."""
    return _page(living(albums, indexed).select(*_shown(albums), "updated_at", "discovered_at"), _recent(), limit, offset, files).drop("updated_at", "discovered_at")


def living(albums: DataFrame, indexed: bool | None = None) -> DataFrame:
    rows = albums.filter("dead = 0")
    return rows if indexed is None else rows.filter(F.col("indexed_at").isNotNull() if indexed else F.col("indexed_at").isNull())


def listed(albums: DataFrame, files: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """The album search without a query: all albums, dead ones too."""
    return _page(albums.select(*_shown(albums), "updated_at", "discovered_at"), _recent(), limit, offset, files).drop("updated_at", "discovered_at")


def title_prefix(albums: DataFrame, files: DataFrame, q: str, limit: int = 20, offset: int = 0) -> DataFrame:
    return _page(albums.filter(L.starts(q, "title")).select(*_shown(albums)), [F.asc("title"), F.asc("id")], limit, offset, files)


def title_hits(albums: DataFrame, q: str) -> DataFrame:
    """Albums whose title holds all trigrams of a query, with their BM25 score (smaller is better).

    The score needs per trigram the number of titles with it, and the number
    and length of all titles: one pass of conditional sums.  Trigrams are
    only located inside titles that hold all of them.  Trigram lengths are
    taken from the title as stored.
    """
    wanted = L.query_grams(q)
    if wanted is None:
        raise ValueError("the query has no trigrams")
    wanted = [g.lower() for g in wanted]
    distinct = list(dict.fromkeys(wanted))
    low = F.lower(F.coalesce("title", F.lit("")))
    length = F.greatest(F.char_length(F.coalesce("title", F.lit(""))) - 2, F.lit(0))
    counts = albums.agg(
        F.struct(
            F.count("*").cast("double").alias("n"), F.sum(length).cast("double").alias("all_length"),
            *[F.count_if(F.contains(low, F.lit(g))).cast("double").alias(f"df{i}") for i, g in enumerate(distinct)],
        ).alias("s")
    ).scalar()
    hits = albums.filter(reduce(lambda a, b: a & b, [F.contains(low, F.lit(g)) for g in distinct])).withColumn("_s", counts)
    held = lambda g: F.size(F.filter(trigrams(F.coalesce("title", F.lit(""))), lambda x: x == g)).cast("double")
    n, average = F.col("_s.n"), F.col("_s.all_length") / F.col("_s.n")
    score = F.lit(0.0)
    for g in wanted:
        df = F.col(f"_s.df{distinct.index(g)}")
        idf = F.log((n - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        tf = held(g)
        score = score - idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length.cast("double") / average))
    return hits.withColumn("score", score).drop("_s")


def title_search(albums: DataFrame, files: DataFrame, q: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Albums by BM25 over trigrams of the title, dead ones included."""
    ranked = title_hits(albums, q).select(*_shown(albums), "score")
    return _page(ranked, [F.asc("score"), F.asc("id")], limit, offset, files)


def search_albums(albums: DataFrame, files: DataFrame, q: str = "", limit: int = 20, offset: int = 0) -> dict[str, Any]:
    """Album search; the total is 0 without a query, exact with trigrams, and that of the page for a prefix."""
    mode = L.mode_of(q)
    if mode == "list":
        page, order, total = listed(albums, files, limit, offset), None, 0
    elif mode == "fts":
        page, order, total = title_search(albums, files, q, limit, offset), ["score", "id"], title_hits(albums, q).count()
    else:
        page, order, total = title_prefix(albums, files, q, limit, offset), ["title", "id"], None
    rows = [r.asDict() for r in (page.orderBy(*order) if order else page).collect()]
    return {"query": q.strip(), "total": len(rows) if total is None else total, "results": rows}


def eligible(albums: DataFrame, files: DataFrame) -> DataFrame:
    """Living, indexed albums that hold a file: what a random choice is made from."""
    return albums.filter("dead = 0 AND indexed_at IS NOT NULL").join(files.select(F.col("album_id").alias(ALBUM_KEY)), ALBUM_KEY, "left_semi")


def random_album(albums: DataFrame, files: DataFrame, seed: int | None = None) -> DataFrame:
    """One of the eligible albums, each as likely as the next."""
    page = eligible(albums, files).orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1)
    return _with_counts(page.select(*_shown(albums)), files, True)


def first_from(albums: DataFrame, files: DataFrame, least_id: int) -> DataFrame:
    """The first eligible album from an id on."""
    page = eligible(albums, files).filter(F.col("id") >= least_id).orderBy("id").limit(1)
    return _with_counts(page.select(*_shown(albums)), files, True)


def group_page(page: DataFrame) -> DataFrame:
    """A result page (with its position ``pos``) as one row an album, in the order of the albums' first rows."""
    return page.groupBy("album_id").agg(
        F.min("pos").alias("first_pos"),
        F.coalesce(F.nullif(F.max("album_title"), F.lit("")), F.first("album_id")).alias("album_title"),
        F.count("*").alias("files"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string")), ",").alias("ids"),
    )


def combined(files: DataFrame, albums: DataFrame, q: str, per: int = 20) -> tuple[DataFrame, DataFrame]:
    """A page of files and the five best albums for the same query."""
    by_title = title_search(albums, files, q, 5) if L.mode_of(q) == "fts" else title_prefix(albums, files, q, 5)
    return file_page(files, albums, q, limit=per), by_title
