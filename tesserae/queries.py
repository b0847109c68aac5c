"""Queries of the catalog operators over the test tables, each with the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .functions.storage import shared_path
from .operators import index, merge, search, state
from .plans import language
from .sources import pages
from .sources.schema import ALBUM_KEY, Catalog
from .streaming import ingest

AS_OF = "2026-01-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Callable[..., DataFrame], tables: tuple[str, ...], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: query(*[_t(spark, sf_dir, t) for t in tables])
    if sql is not None:
        _SQL[name] = sql


_FOLD = f"'{scalars.UPPER}', '{scalars.LOWER}'"


def _sql_fold(column: str) -> str:
    return f"translate({column}, {_FOLD})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --------------------------------------------------------------------------- file search

_SQL_ORDER = {
    "newest": "uploaded_at DESC NULLS LAST, id DESC", "oldest": "uploaded_at ASC NULLS LAST, id ASC", "size": "size DESC NULLS LAST, id DESC",
    "name": f"{_sql_fold('search_name')} ASC, id ASC", "relevance": "length(search_name) ASC, id DESC",
}


def _sql_any(*spelt: str) -> str:
    """One term: any of its spellings in any of the three names."""
    hits = [f"contains({_sql_fold(c)}, {_quoted(v)})" for v in spelt for c in ("search_name", "storage", "slug")]
    return "(" + " OR ".join(hits) + ")"


def _sql_page(where: str, order: str, limit: int = 20, offset: int = 0) -> str:
    return (
        f"SELECT f.*, a.title AS album_title, a.thumb AS album_thumb FROM (SELECT id, album_id, file_id, search_name, storage, slug, mime, media, extension, size, uploaded_at"
        f" FROM files WHERE {where} ORDER BY {_SQL_ORDER[order]} LIMIT {limit} OFFSET {offset}) f JOIN albums a ON a.{ALBUM_KEY} = f.album_id"
    )


def _page(name: str, where: str, order: str, limit: int = 20, offset: int = 0, **asked) -> None:
    _add(name, lambda files, albums: search.file_page(files, albums, limit=limit, offset=offset, **asked), ("files", "albums"), _sql_page(where, order, limit, offset))


_page("files_list_newest", "true", "newest")
_page("files_list_oldest", "true", "oldest", sort="oldest")
_page("files_list_size", "true", "size", sort="size")
_page("files_offset", "true", "newest", 20, 1000)
_page("files_prefix_name", f"starts_with({_sql_fold('search_name')}, 'co')", "name", q="Co")
_page("files_prefix_newest", f"starts_with({_sql_fold('search_name')}, 'co')", "newest", q="Co", sort="newest")
_TWO = f"{_sql_any('harbor')} AND {_sql_any('velvet')}"
_page("files_fts_relevance", _sql_any("harbor"), "relevance", q="Harbor")
_page("files_fts_newest", _sql_any("harbor"), "newest", q="harbor", sort="newest")
_page("files_fts_oldest", _sql_any("harbor"), "oldest", q="harbor", sort="oldest")
_page("files_fts_size", _sql_any("harbor"), "size", q="harbor", sort="size")
_page("files_multiword", _TWO, "relevance", q="harbor velvet")
_page("files_phrase", _sql_any("silver mirror", "silver_mirror", "silver-mirror", "silvermirror"), "relevance", q='"silver mirror"')
_page("files_mixed_sep", f"{_sql_any('silver')} AND {_sql_any('mirror')}", "relevance", q="silver.mirror")
_page("files_short_fallback", _sql_any("kettle 1", "kettle_1", "kettle-1", "kettle1"), "relevance", q="kettle 1")
_page("files_punctuation", _sql_any("(1)"), "relevance", q="(1)")
_page("files_keyword_grams", _sql_any("island"), "relevance", q="ISLAND")
_page("files_unicode", _sql_any("straße"), "relevance", q="straße")
_page("files_media_image", "media IN ('Image', 'GIF')", "newest", media="image")
_page("files_media_video", "media IN ('Video')", "newest", media="video")
_page("files_media_audio", "media IN ('Audio')", "newest", media="audio")
_page("files_media_other", "media NOT IN ('Image', 'GIF', 'Video', 'Audio')", "newest", media="other")
_page("files_ext", "extension = 'png'", "newest", extension=".PNG")


def _after(name: str, where: str, then: str, order: str, key: dict, **asked) -> None:
    kind_key = dict(key)
    _add(name, lambda files, albums: search.file_page(files, albums, limit=20, cursor_key=kind_key, **asked), ("files", "albums"), _sql_page(f"({where}) AND ({then})", order))


_after("files_keyset_relevance", _sql_any("harbor"), "length(search_name) > 24 OR (length(search_name) = 24 AND id < 9000)", "relevance", {"id": 9000, "score": 24}, q="harbor")
_after("files_keyset_name", f"starts_with({_sql_fold('search_name')}, 'co')", f"{_sql_fold('search_name')} > 'cover.jpg' OR ({_sql_fold('search_name')} = 'cover.jpg' AND id > 50)", "name", {"id": 50, "search_name": "COVER.jpg"}, q="co")
_after("files_keyset_size", "true", "size IS NULL OR size < 1000000 OR (size = 1000000 AND id < 10)", "size", {"id": 10, "size": 1000000}, sort="size")
_after("files_keyset_newest", "true", "uploaded_at IS NULL OR uploaded_at < TIMESTAMP '2023-06-01 00:00:00' OR (uploaded_at = TIMESTAMP '2023-06-01 00:00:00' AND id < 5)", "newest", {"id": 5, "uploaded_at": "2023-06-01T00:00:00"})
_after("files_keyset_oldest", "true", "uploaded_at IS NULL OR uploaded_at > TIMESTAMP '2023-06-01 00:00:00' OR (uploaded_at = TIMESTAMP '2023-06-01 00:00:00' AND id > 5)", "oldest", {"id": 5, "uploaded_at": "2023-06-01T00:00:00"}, sort="oldest")
_after("files_keyset_nulltime", "true", "uploaded_at IS NULL AND id < 15000", "newest", {"id": 15000, "uploaded_at": None})

_add(
    "files_capped_total", lambda files: search.capped_total(search.file_hits(files, "harbor", columns=["id"]), 100), ("files",),
    f"SELECT least(count(*), 100)::BIGINT AS total, count(*) > 100 AS truncated FROM (SELECT 1 FROM files WHERE {_sql_any('harbor')})",
)
_add(
    "files_exact_total", lambda files: search.capped_total(search.file_hits(files, "harbor velvet", columns=["id"])), ("files",),
    f"SELECT least(count(*), 50000)::BIGINT AS total, count(*) > 50000 AS truncated FROM (SELECT 1 FROM files WHERE {_TWO} LIMIT 50001)",
)


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of a search, each from the cursor of the one before (an offset counts only without one); what each says of its total and of more."""
    files, albums = _t(spark, sf_dir, "files"), _t(spark, sf_dir, "albums")
    cursor, rows = None, []
    for page in range(3):
        found = search.search_files(files, albums, "harbor", sort="oldest", limit=20, offset=7, cursor=cursor)
        rows += [(page, pos, r["id"], found["total"], found["has_more"]) for pos, r in enumerate(found["results"])]
        cursor = found["next_cursor"]
    return spark.createDataFrame(rows, "page int, pos int, id long, total long, has_more boolean")


_QUERIES["files_cursor_walk"] = _walk
_SQL["files_cursor_walk"] = f"""WITH h AS (SELECT id, album_id, row_number() OVER (ORDER BY {_SQL_ORDER['oldest']}) - 8 AS n, count(*) OVER () AS total FROM files WHERE {_sql_any('harbor')})
SELECT (n // 20)::INT AS page, (n % 20)::INT AS pos, id, total, total - 8 >= (n // 20 + 1) * 20 AS has_more FROM h WHERE n >= 0 AND n < 60"""


def _grouped(files: DataFrame, albums: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    page = search.file_page(files, albums, "harbor", sort="newest", limit=100)
    return search.group_page(page.withColumn("pos", F.row_number().over(Window.orderBy(*language.order_by("newest"))).cast("long")))


_add(
    "files_group_by_album", _grouped, ("files", "albums"),
    f"""SELECT album_id, min(pos) AS first_pos, coalesce(nullif(max(album_title), ''), first(album_id)) AS album_title, count(*) AS files,
               string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids
        FROM (SELECT *, row_number() OVER (ORDER BY {_SQL_ORDER['newest']}) AS pos FROM ({_sql_page(_sql_any('harbor'), 'newest', 100)})) GROUP BY album_id""",
)


def _index(spark: SparkSession, sf_dir: str) -> str:
    """An index of the whole files, of which a tenth is taken in by a later delta that replaces it."""
    path = shared_path(spark, "index")
    files = _t(spark, sf_dir, "files")
    index.write(files, path)
    changed = files.filter(F.col("id") % 10 == 0)
    index.add(changed, path, 1, changed)
    return path


_QUERIES["files_trigram_index"] = lambda spark, sf_dir: index.search(spark, _index(spark, sf_dir), "harbor", ["id"])
_SQL["files_trigram_index"] = f"SELECT id FROM files WHERE {_sql_any('harbor')}"
_QUERIES["files_prefix_index"] = lambda spark, sf_dir: index.search(spark, _index(spark, sf_dir), "Co", ["id"])
_SQL["files_prefix_index"] = f"SELECT id FROM files WHERE starts_with({_sql_fold('search_name')}, 'co')"

# --------------------------------------------------------------------------- albums

_SQL_ALBUM = f"a.id, a.{ALBUM_KEY}, a.title, a.file_count, a.thumb, (a.indexed_at IS NOT NULL)::INT AS indexed, a.dead, (SELECT count(*) FROM files f WHERE f.album_id = a.{ALBUM_KEY}) AS real_files"
_SQL_RECENT = "coalesce(a.updated_at, a.discovered_at) DESC NULLS LAST, a.id DESC"


def _albums(name: str, query: Callable[..., DataFrame], where: str, order: str, limit: int = 20) -> None:
    _add(name, query, ("albums", "files"), f"SELECT {_SQL_ALBUM} FROM albums a WHERE {where} ORDER BY {order} LIMIT {limit}")


_albums("albums_browse", search.browse, "a.dead = 0", _SQL_RECENT)
_albums("albums_browse_indexed", lambda a, f: search.browse(a, f, True), "a.dead = 0 AND a.indexed_at IS NOT NULL", _SQL_RECENT)
_albums("albums_browse_unindexed", lambda a, f: search.browse(a, f, False), "a.dead = 0 AND a.indexed_at IS NULL", _SQL_RECENT)
_albums("albums_empty_query", search.listed, "true", _SQL_RECENT)
_albums("albums_prefix", lambda a, f: search.title_prefix(a, f, "Ve"), f"starts_with({_sql_fold('a.title')}, 've')", "a.title, a.id")
_ELIGIBLE = f"a.dead = 0 AND a.indexed_at IS NOT NULL AND EXISTS (SELECT 1 FROM files f WHERE f.album_id = a.{ALBUM_KEY})"
_albums("album_first_ge_id", lambda a, f: search.first_from(a, f, 200), f"a.id >= 200 AND {_ELIGIBLE}", "a.id", 1)
_add("albums_eligible", lambda a, f: search.eligible(a, f).select("id"), ("albums", "files"), f"SELECT a.id FROM albums a WHERE {_ELIGIBLE}")
_add("random_album", lambda a, f: search.random_album(a, f).join(search.eligible(a, f).select("id"), "id", "left_semi").agg(F.count("*").alias("eligible_found")), ("albums", "files"), f"SELECT least(count(*), 1)::BIGINT AS eligible_found FROM albums a WHERE {_ELIGIBLE}")
_add("albums_real_files", lambda a, f: search.real_files(a, f).select("id", "real_files"), ("albums", "files"), f"SELECT a.id, count(f.id) AS real_files FROM albums a LEFT JOIN files f ON f.album_id = a.{ALBUM_KEY} GROUP BY a.id")
_add(
    "albums_browsable", lambda a, f: search.real_files(search.living(a, True), f).filter("real_files > 0").select("id", "real_files"), ("albums", "files"),
    f"SELECT a.id, count(*) AS real_files FROM albums a JOIN files f ON f.album_id = a.{ALBUM_KEY} WHERE a.dead = 0 AND a.indexed_at IS NOT NULL GROUP BY a.id",
)
_add(
    "albums_browse_total", lambda a: search.living(a, True).agg(F.count("*").alias("total")), ("albums",),
    "SELECT count(*) AS total FROM albums WHERE dead = 0 AND indexed_at IS NOT NULL",
)


def _sql_bm25(q: str) -> str:
    grams = [g.lower() for g in language.query_grams(q)]
    held = " AND ".join(f"contains(low, '{g}')" for g in dict.fromkeys(grams))
    counts = ", ".join(f"sum(contains(low, '{g}')::INT)::DOUBLE AS df{i}" for i, g in enumerate(grams))
    parts = " + ".join(
        f"(CASE WHEN ln((s.n - s.df{i} + 0.5) / (s.df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((s.n - s.df{i} + 0.5) / (s.df{i} + 0.5)) END) * t.tf{i} * 2.2"
        f" / (t.tf{i} + 1.2 * (0.25 + 0.75 * t.len / (s.all_len / s.n)))"
        for i in range(len(grams))
    )
    tf = ", ".join(f"len(list_filter(range(1, length(low) - 1), lambda i: substr(low, i, 3) = '{g}'))::DOUBLE AS tf{i}" for i, g in enumerate(grams))
    return (
        f"WITH d AS (SELECT id, lower(coalesce(title, '')) AS low, greatest(length(coalesce(title, '')) - 2, 0)::DOUBLE AS len FROM albums),"
        f" s AS (SELECT count(*)::DOUBLE AS n, sum(len) AS all_len, {counts} FROM d), t AS (SELECT id, len, {tf} FROM d WHERE {held})"
        f" SELECT t.id, round(-({parts}), 9) AS score FROM t, s"
    )


def _scores(q: str) -> Callable[[DataFrame], DataFrame]:
    return lambda a: search.title_hits(a, q).select("id", F.round("score", 9).alias("score"))


_add("albums_bm25", _scores("harbor"), ("albums",), _sql_bm25("harbor"))
_add("albums_trigram", _scores("lumora set"), ("albums",), _sql_bm25("lumora set"))
_add(
    "albums_bm25_page", lambda a, f: search.title_search(a, f, "harbor").select("id", "title", "real_files", F.round("score", 9).alias("score")), ("albums", "files"),
    f"SELECT a.id, a.title, (SELECT count(*) FROM files f WHERE f.album_id = a.{ALBUM_KEY}) AS real_files, x.score FROM ({_sql_bm25('harbor')}) x JOIN albums a USING (id) ORDER BY x.score, a.id LIMIT 20",
)


def _combined(q: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def query(files: DataFrame, albums: DataFrame) -> DataFrame:
        page, titles = search.combined(files, albums, q)
        return page.select(F.lit("file").alias("kind"), "id", F.col("search_name").alias("name")).unionByName(titles.select(F.lit("album").alias("kind"), "id", F.col("title").alias("name")))

    return query


def _sql_combined(files: str, titles: str) -> str:
    return f"SELECT 'file' AS kind, id, search_name AS name FROM ({files}) UNION ALL SELECT 'album', id, title FROM ({titles})"


_add(
    "combined_search", _combined("ve"), ("files", "albums"),
    _sql_combined(_sql_page(f"starts_with({_sql_fold('search_name')}, 've')", "name"), f"SELECT id, title FROM albums WHERE starts_with({_sql_fold('title')}, 've') ORDER BY title, id LIMIT 5"),
)
_add(
    "combined_search_fts", _combined("harbor"), ("files", "albums"),
    _sql_combined(_sql_page(_sql_any("harbor"), "relevance"), f"SELECT a.id, a.title FROM ({_sql_bm25('harbor')}) x JOIN albums a USING (id) ORDER BY x.score, a.id LIMIT 5"),
)

# --------------------------------------------------------------------------- state


def _us(column: str) -> F.Column:
    return F.unix_micros(column).alias(column.replace("_at", "_us"))


_add(
    "stats", lambda a, f: state.stats(a, f).select("*", _us("last_indexed_at"), _us("last_discovered_at")).drop("last_indexed_at", "last_discovered_at"), ("albums", "files"),
    """SELECT count(*) AS albums_total, count(*) FILTER (indexed_at IS NOT NULL AND dead = 0) AS albums_indexed, count(*) FILTER (dead = 1) AS albums_dead,
       count(*) FILTER (dead = 0 AND attempts < 5 AND indexed_at IS NULL) AS albums_pending, count(*) FILTER (dead = 0 AND attempts >= 5) AS albums_stuck,
       epoch_us(max(indexed_at)) AS last_indexed_us, epoch_us(max(discovered_at)) AS last_discovered_us, (SELECT count(*) FROM files) AS files FROM albums""",
)
_DUE = "dead = 0 AND attempts < 5 AND (indexed_at IS NULL{})"
_STALE = " OR indexed_at::TIMESTAMP::DATE < DATE '2026-01-01' - 400"
_QUEUE = f"SELECT id, {ALBUM_KEY}, title, attempts FROM albums WHERE {{}} ORDER BY (indexed_at IS NOT NULL), discovered_at DESC NULLS LAST, id DESC LIMIT 200"
_add("queue_pending", lambda a: state.pending(a, AS_OF), ("albums",), _QUEUE.format(_DUE.format("")))
_add("queue_stale", lambda a: state.pending(a, AS_OF, 200, 400), ("albums",), _QUEUE.format(_DUE.format(_STALE)))
_add("queue_count", lambda a: state.pending_count(a, AS_OF, 400), ("albums",), f"SELECT count(*) AS pending FROM albums WHERE {_DUE.format(_STALE)}")
_add("refresh_ids", lambda a: state.refresh_ids(a, 50), ("albums",), f"SELECT id, {ALBUM_KEY} FROM albums WHERE dead = 0 ORDER BY (indexed_at IS NULL) DESC, discovered_at DESC NULLS LAST, id DESC LIMIT 50")
_add(
    "outcome_summary", state.outcome_summary, ("crawl_outcomes",),
    "SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'dead') AS dead, count(*) FILTER (status = 'error') AS error, coalesce(sum(file_rows), 0)::BIGINT AS files, count(*) FILTER (rate_limited) AS rate_limited FROM crawl_outcomes",
)
_ANSWERED = "sum(CASE WHEN status IN ('ok', 'dead') THEN 1 ELSE 0 END) OVER (ORDER BY fetched_at, outcome_id)"
_add(
    "breaker_log", state.breaker_log, ("crawl_outcomes",),
    f"""WITH answered AS (SELECT outcome_id, fetched_at, rate_limited, {_ANSWERED} AS answers FROM crawl_outcomes),
       failed AS (SELECT outcome_id, row_number() OVER (PARTITION BY answers ORDER BY fetched_at, outcome_id) AS failures FROM answered WHERE rate_limited)
       SELECT outcome_id, (CASE WHEN failures % 2 = 0 THEN least(300, 10 * power(2, failures / 2 - 1)) ELSE 0 END)::DOUBLE AS pause_s FROM failed""",
)


def _waves(outcomes: DataFrame) -> DataFrame:
    found = state.crawl_waves(outcomes)
    rate, hours = state.throughput(F.col("processed"), F.col("span_us"), F.lit(1000))
    return found.withColumns({"per_s": F.round(rate, 6), "eta_h": F.round(hours, 6)})


def _sql_waves(limit: str) -> str:
    return f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY fetched_at, outcome_id) - 1 AS place FROM crawl_outcomes),
       w AS (SELECT place // 200 AS wave, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'dead') AS dead, count(*) FILTER (status = 'error') AS error,
                    coalesce(sum(file_rows) FILTER (status = 'ok'), 0) AS files, min(fetched_at) AS began, max(fetched_at) AS ended FROM o WHERE {limit} GROUP BY 1),
       b AS (SELECT *, error = n AND sum(ok) OVER (ORDER BY wave) = 0 AS blocked FROM w),
       k AS (SELECT * FROM b WHERE wave <= coalesce((SELECT min(wave) FROM b WHERE blocked), wave)),
       t AS (SELECT coalesce(sum(n), 0)::BIGINT AS processed, coalesce(sum(ok), 0)::BIGINT AS ok, coalesce(sum(dead), 0)::BIGINT AS dead, coalesce(sum(error), 0)::BIGINT AS error,
                    coalesce(sum(files), 0)::BIGINT AS files, epoch_us(max(ended)) - epoch_us(min(began)) AS span_us, bool_or(blocked) AS blocked FROM k)"""


_add(
    "crawl_waves", _waves, ("crawl_outcomes",),
    _sql_waves("true") + """ SELECT processed, ok, dead, error, files, span_us, CASE WHEN blocked THEN 'all_errors' ELSE 'queue_empty' END AS stopped,
       round(processed * 1e6 / span_us, 6) AS per_s, round(1000 / (processed * 1e6 / span_us) / 3600, 6) AS eta_h FROM t""",
)
_add(
    "crawl_waves_blocked", lambda o: state.crawl_waves(o.withColumn("status", F.when(F.col("fetched_at") < "2030-01-01", F.lit("error")).otherwise(F.col("status"))), limit=500), ("crawl_outcomes",),
    _sql_waves("place < 500").replace("FROM crawl_outcomes)", "FROM (SELECT * REPLACE ('error' AS status) FROM crawl_outcomes))") + " SELECT processed, ok, dead, error, files, span_us, CASE WHEN blocked THEN 'all_errors' ELSE 'limit' END AS stopped FROM t",
)
_add(
    "crawl_waves_limit", lambda o: state.crawl_waves(o, limit=500), ("crawl_outcomes",),
    _sql_waves("place < 500") + " SELECT processed, ok, dead, error, files, span_us, CASE WHEN blocked THEN 'all_errors' WHEN processed >= 500 THEN 'limit' ELSE 'queue_empty' END AS stopped FROM t",
)


def _attempts(outcomes: DataFrame) -> DataFrame:
    """The outcomes as a log of attempts: what an answer of that kind looks like."""
    status = F.when(F.col("status") == "ok", 200).when(F.col("status") == "dead", 404).when(F.col("rate_limited"), 429)
    return outcomes.select(ALBUM_KEY, F.col("outcome_id").alias("attempt_no"), status.alias("http_status"), (F.col("status") == "ok").alias("has_files"))


_add(
    "classify_attempts", lambda o: state.classify_attempts(_attempts(o)), ("crawl_outcomes",),
    f"""WITH d AS (SELECT {ALBUM_KEY}, min(outcome_id) FILTER (status IN ('ok', 'dead')) AS decided FROM crawl_outcomes GROUP BY 1)
    SELECT {ALBUM_KEY}, CASE WHEN decided IS NULL THEN 'error' ELSE max(status) FILTER (outcome_id = decided) END AS status,
      decided IS NULL AND bool_and(status = 'error' AND rate_limited) AS rate_limited FROM crawl_outcomes JOIN d USING ({ALBUM_KEY}) GROUP BY {ALBUM_KEY}, decided""",
)

# --------------------------------------------------------------------------- merges

_STATE = ["id", ALBUM_KEY, "title", "file_count", "thumb", "attempts", "last_error", "dead"]


def _shown(albums: DataFrame) -> DataFrame:
    return albums.select(*_STATE, _us("discovered_at"), _us("updated_at"), _us("indexed_at"))


_NOW = "epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00')"
_CARDS = f"""b AS (SELECT {ALBUM_KEY}, arg_max(coalesce(title, ''), (seen_at, card_id)) AS title, arg_max(coalesce(file_count, 0), (seen_at, card_id)) AS file_count,
  coalesce(arg_max(thumb, (seen_at, card_id)) FILTER (thumb <> ''), '') AS thumb, min((seen_at, card_id)) AS first_card FROM discovery_cards WHERE {ALBUM_KEY} IS NOT NULL GROUP BY 1)"""
_ALL_CARDS = f"cards AS (SELECT * FROM discovery_cards UNION ALL SELECT * REPLACE ('new' || {ALBUM_KEY} AS {ALBUM_KEY}) FROM discovery_cards WHERE card_id % 10 = 0)"


def _with_new(batch: DataFrame, number: str) -> DataFrame:
    """The whole batch and, as every key of the tables is known, a tenth of it once more under keys that are not."""
    fresh = batch.filter(F.col(number) % 10 == 0).withColumn(ALBUM_KEY, F.concat(F.lit("new"), ALBUM_KEY))
    return batch.unionByName(fresh)


_add(
    "count_new", lambda a, c: merge.count_new(a, _with_new(c, "card_id")), ("albums", "discovery_cards"),
    f"WITH {_ALL_CARDS} SELECT count(*) AS new_albums FROM cards WHERE {ALBUM_KEY} NOT IN (SELECT {ALBUM_KEY} FROM albums)",
)

_LAST = f"last AS (SELECT {ALBUM_KEY}, arg_max(status, (fetched_at, outcome_id)) AS status, arg_max(message, (fetched_at, outcome_id)) AS message FROM crawl_outcomes GROUP BY 1)"


def _last_outcomes(outcomes: DataFrame) -> DataFrame:
    at = F.struct("fetched_at", "outcome_id")
    return outcomes.groupBy(ALBUM_KEY).agg(F.max_by("status", at).alias("status"), F.max_by("message", at).alias("message"))


def _batch(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The files of albums whose last fetch was a success, as a new batch."""
    ok = _last_outcomes(outcomes).filter("status = 'ok'").select(F.col(ALBUM_KEY).alias("album_id"))
    return files.join(ok, "album_id", "left_semi").withColumn("pos", F.col("id"))


_TWICE = f"{_LAST}, n AS (SELECT * FROM files WHERE album_id IN (SELECT {ALBUM_KEY} FROM last WHERE status = 'ok')), twice AS (SELECT DISTINCT album_id FROM n GROUP BY album_id, file_id HAVING count(*) > 1)"
_add(
    "quarantine_dup_files", lambda f, o: merge.split_duplicates(_batch(f, o))[1], ("files", "crawl_outcomes"),
    f"WITH {_TWICE} SELECT album_id FROM twice",
)
_EXT = r"lower(regexp_extract(regexp_extract(replace(coalesce({0}, ''), chr(92), '/'), '(?s)([^/]*)$', 1), '(?s)^.*\.([A-Za-z0-9]{{1,16}})$', 1))"


def _replace_files(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    sound, _ = merge.split_duplicates(_batch(files, outcomes))
    out = merge.replace_files(files, sound, sound.select("album_id"))
    return out.select("id", "album_id", "file_id", "search_name", "media", "extension", "size")


_add(
    "replace_files", _replace_files, ("files", "crawl_outcomes"),
    f"""WITH {_TWICE}, sound AS (SELECT * FROM n WHERE album_id NOT IN (SELECT album_id FROM twice))
    SELECT id, album_id, file_id, search_name, media, extension, size FROM files WHERE album_id NOT IN (SELECT album_id FROM sound)
    UNION ALL SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY id), album_id, file_id, coalesce(search_name, ''), coalesce(media, ''),
      coalesce(nullif(extension, ''), {_EXT.format('search_name')}), coalesce(size, 0) FROM sound""",
)


def _replacements(albums: DataFrame, files: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The albums of sound files as parsed again, and their numbers of files."""
    sound, _ = merge.split_duplicates(_batch(files, outcomes))
    counts = sound.groupBy("album_id").agg(F.count("*").alias("n"))
    parsed = albums.select(ALBUM_KEY, F.concat("title", F.lit(" +")).alias("title"), F.lit("").alias("thumb"), F.col("id").alias("pos")).join(counts.select(F.col("album_id").alias(ALBUM_KEY)), ALBUM_KEY, "left_semi")
    return parsed, counts


def _set_pending(albums: DataFrame, cards: DataFrame) -> DataFrame:
    return _shown(merge.set_pending(albums, _with_new(cards, "card_id").select(ALBUM_KEY, F.col("card_id").alias("pos")), AS_OF))


def _replace_albums(albums: DataFrame, files: DataFrame, outcomes: DataFrame) -> DataFrame:
    parsed, counts = _replacements(albums, files, outcomes)
    return _shown(merge.replace_albums(albums, _with_new(parsed, "pos"), counts, AS_OF))


_add(
    "upsert_discovered", lambda a, c: _shown(merge.upsert_discovered(a, _with_new(c, "card_id"), AS_OF, ["seen_at", "card_id"])), ("albums", "discovery_cards"),
    f"""WITH {_ALL_CARDS}, {_CARDS.replace("discovery_cards", "cards")}
    SELECT s.id, s.{ALBUM_KEY}, coalesce(b.title, s.title) AS title, coalesce(b.file_count, s.file_count) AS file_count,
      CASE WHEN b.thumb <> '' THEN b.thumb ELSE s.thumb END AS thumb, attempts, last_error, dead,
      epoch_us(discovered_at) AS discovered_us, epoch_us(updated_at) AS updated_us, epoch_us(indexed_at) AS indexed_us FROM albums s LEFT JOIN b USING ({ALBUM_KEY})
    UNION ALL SELECT (SELECT max(id) FROM albums) + row_number() OVER (ORDER BY first_card), {ALBUM_KEY}, title, file_count, thumb, 0, '', 0, {_NOW}, {_NOW}, NULL
      FROM b WHERE {ALBUM_KEY} NOT IN (SELECT {ALBUM_KEY} FROM albums)""",
)
_add(
    "set_pending", _set_pending, ("albums", "discovery_cards"),
    f"""WITH {_ALL_CARDS}, b AS (SELECT {ALBUM_KEY}, min(card_id) AS pos FROM cards GROUP BY 1)
    SELECT s.id, s.{ALBUM_KEY}, title, file_count, thumb, CASE WHEN pos IS NULL THEN attempts ELSE 0 END AS attempts, CASE WHEN pos IS NULL THEN last_error ELSE '' END AS last_error,
      CASE WHEN pos IS NULL THEN dead ELSE 0 END AS dead, epoch_us(discovered_at) AS discovered_us, CASE WHEN pos IS NULL THEN epoch_us(updated_at) ELSE {_NOW} END AS updated_us,
      CASE WHEN pos IS NULL THEN epoch_us(indexed_at) END AS indexed_us FROM albums s LEFT JOIN b USING ({ALBUM_KEY})
    UNION ALL SELECT (SELECT max(id) FROM albums) + row_number() OVER (ORDER BY pos), {ALBUM_KEY}, '', 0, '', 0, '', 0, {_NOW}, {_NOW}, NULL FROM b WHERE {ALBUM_KEY} NOT IN (SELECT {ALBUM_KEY} FROM albums)""",
)
_add(
    "replace_albums", _replace_albums, ("albums", "files", "crawl_outcomes"),
    f"""WITH {_TWICE}, c AS (SELECT album_id, count(*) AS n FROM n WHERE album_id NOT IN (SELECT album_id FROM twice) GROUP BY 1),
    k AS (SELECT a.{ALBUM_KEY}, a.title || ' +' AS title, a.id AS pos, c.n FROM albums a JOIN c ON c.album_id = a.{ALBUM_KEY}),
    p AS (SELECT * FROM k UNION ALL SELECT * REPLACE ('new' || {ALBUM_KEY} AS {ALBUM_KEY}) FROM k WHERE pos % 10 = 0)
    SELECT s.id, s.{ALBUM_KEY}, CASE WHEN pos IS NULL THEN s.title ELSE p.title END AS title, CASE WHEN pos IS NULL THEN file_count ELSE n END AS file_count, thumb,
      CASE WHEN pos IS NULL THEN attempts ELSE 0 END AS attempts, CASE WHEN pos IS NULL THEN last_error ELSE '' END AS last_error, CASE WHEN pos IS NULL THEN dead ELSE 0 END AS dead,
      epoch_us(discovered_at) AS discovered_us, CASE WHEN pos IS NULL THEN epoch_us(updated_at) ELSE {_NOW} END AS updated_us, CASE WHEN pos IS NULL THEN epoch_us(indexed_at) ELSE {_NOW} END AS indexed_us
    FROM albums s LEFT JOIN p USING ({ALBUM_KEY})
    UNION ALL SELECT (SELECT max(id) FROM albums) + row_number() OVER (ORDER BY pos), {ALBUM_KEY}, title, 0, '', 0, '', 0, {_NOW}, {_NOW}, {_NOW} FROM p WHERE {ALBUM_KEY} NOT IN (SELECT {ALBUM_KEY} FROM albums)""",
)


def _mark(albums: DataFrame, outcomes: DataFrame) -> DataFrame:
    failed = _last_outcomes(outcomes).filter("status <> 'ok'").select(ALBUM_KEY, "message", (F.col("status") == "dead").alias("dead"))
    return _shown(merge.mark_errors(albums, failed, AS_OF))


_add(
    "mark_error", _mark, ("albums", "crawl_outcomes"),
    f"""WITH {_LAST}, e AS (SELECT {ALBUM_KEY}, substr(coalesce(message, ''), 1, 500) AS err, status = 'dead' AS died FROM last WHERE status <> 'ok')
    SELECT id, {ALBUM_KEY}, title, file_count, thumb, attempts + (err IS NOT NULL)::INT AS attempts, coalesce(err, last_error) AS last_error, CASE WHEN died THEN 1 ELSE dead END AS dead,
      epoch_us(discovered_at) AS discovered_us, CASE WHEN err IS NULL THEN epoch_us(updated_at) ELSE {_NOW} END AS updated_us, epoch_us(indexed_at) AS indexed_us FROM albums LEFT JOIN e USING ({ALBUM_KEY})""",
)
_add(
    "apply_outcomes", lambda a, o: _shown(merge.apply_outcomes(a, o)), ("albums", "crawl_outcomes"),
    f"""WITH l AS (SELECT min(outcome_id) AS outcome_id, {ALBUM_KEY}, status, message, file_rows, fetched_at FROM crawl_outcomes GROUP BY {ALBUM_KEY}, status, message, rate_limited, file_rows, parse_error, fetched_at),
    k AS (SELECT {ALBUM_KEY}, max(fetched_at) AS ok_at, arg_max(file_rows, fetched_at) AS file_rows FROM l WHERE status = 'ok' GROUP BY 1),
    e AS (SELECT {ALBUM_KEY}, count(*) AS fails, arg_max(substr(coalesce(message, ''), 1, 500), fetched_at) AS err, max((status = 'dead')::INT) AS died, max(fetched_at) AS failed_at
          FROM l LEFT JOIN k USING ({ALBUM_KEY}) WHERE status <> 'ok' AND (ok_at IS NULL OR fetched_at > ok_at) GROUP BY 1)
    SELECT id, {ALBUM_KEY}, title, CASE WHEN ok_at IS NULL THEN file_count ELSE coalesce(k.file_rows, 0) END AS file_count, thumb,
      ((CASE WHEN ok_at IS NULL THEN attempts ELSE 0 END) + coalesce(fails, 0))::INT AS attempts, coalesce(err, CASE WHEN ok_at IS NULL THEN last_error ELSE '' END) AS last_error,
      greatest(CASE WHEN ok_at IS NULL THEN dead ELSE 0 END, coalesce(died, 0))::INT AS dead, epoch_us(discovered_at) AS discovered_us,
      epoch_us(coalesce(failed_at, ok_at, updated_at)) AS updated_us, epoch_us(coalesce(ok_at, indexed_at)) AS indexed_us
    FROM albums LEFT JOIN k USING ({ALBUM_KEY}) LEFT JOIN e USING ({ALBUM_KEY})""",
)
_add("delete_cascade_files", lambda a, f: merge.delete_albums(a, f, a.filter("dead = 1"))[1].select("id"), ("albums", "files"), f"SELECT id FROM files WHERE album_id NOT IN (SELECT {ALBUM_KEY} FROM albums WHERE dead = 1)")
_add("delete_cascade_albums", lambda a, f: merge.delete_albums(a, f, a.filter("dead = 1"))[0].select("id"), ("albums", "files"), "SELECT id FROM albums WHERE dead <> 1")
_add(
    "backfill_extension", lambda f: merge.backfill_extension(f).select("id", "extension"), ("files",),
    f"SELECT id, CASE WHEN coalesce(extension, '') = '' THEN {_EXT.format('search_name')} ELSE extension END AS extension FROM files",
)
_add(
    "meta_upsert", lambda m: merge.set_meta(m, m.filter("key = 'page_cursor'").withColumn("value", F.lit("413"))), ("meta",),
    "SELECT key, CASE WHEN key = 'page_cursor' THEN '413' ELSE value END AS value FROM meta",
)

# --------------------------------------------------------------------------- discovery


def _paged(cards: DataFrame) -> DataFrame:
    """All cards, a tenth of them under keys that no table knows, in the order of their numbers on each page."""
    return _with_new(cards, "card_id").withColumn("pos", F.col("card_id"))


_SHOWN_ON = f"s AS (SELECT DISTINCT page_no, {ALBUM_KEY} FROM cards), f AS (SELECT min(page_no) AS page_no, {ALBUM_KEY} FROM s WHERE {ALBUM_KEY} NOT IN (SELECT {ALBUM_KEY} FROM albums) GROUP BY 2)"
_PAGES = f"{_ALL_CARDS}, {_SHOWN_ON}, p AS (SELECT s.page_no, count(*) AS cards, count(f.{ALBUM_KEY}) AS new FROM s LEFT JOIN f USING (page_no, {ALBUM_KEY}) GROUP BY 1)"
_add("discover_pages", lambda c, a: state.page_news(_paged(c), a).select(F.col("page_no").cast("long").alias("page_no"), "cards", "new"), ("discovery_cards", "albums"), f"WITH {_PAGES} SELECT page_no::BIGINT AS page_no, cards, new FROM p")


def _discover(name: str, failed: str, empty: str, max_pages: int | None = None, stop_when_known: bool = False) -> None:
    """An ordered run over the pages of the cards: ``failed`` and ``empty`` are conditions on page_no, the same text in both languages."""

    def query(cards: DataFrame, albums: DataFrame) -> DataFrame:
        run = cards.select("page_no").distinct().withColumn("failed", F.expr(failed))
        folded = state.fold_pages(run, _paged(cards).filter(~F.expr(empty)), albums, 1, max_pages, stop_when_known)
        return folded.withColumn("last_page", F.col("last_page").cast("long"))

    ends = ["WHEN failed AND failures >= 5 THEN 'repeated_errors'", "WHEN NOT failed AND cards = 0 THEN 'empty_page'"]
    if stop_when_known:
        ends.append("WHEN NOT failed AND new = 0 THEN 'all_known'")
    cut = "true" if max_pages is None else f"page_no < 1 + {max_pages}"
    at_end = "'pages_exhausted'" if max_pages is None else "'max_pages'"
    _add(
        name, query, ("discovery_cards", "albums"),
        f"""WITH {_ALL_CARDS.replace("card_id % 10 = 0", f"card_id % 10 = 0 AND NOT ({empty})").replace("FROM discovery_cards UNION", f"FROM discovery_cards WHERE NOT ({empty}) UNION")}, {_SHOWN_ON},
        n AS (SELECT DISTINCT page_no, ({failed}) AS failed FROM discovery_cards WHERE {cut}),
        c AS (SELECT s.page_no, count(*) AS cards, count(f.{ALBUM_KEY}) AS new FROM s LEFT JOIN f USING (page_no, {ALBUM_KEY}) GROUP BY 1),
        p AS (SELECT page_no, failed, coalesce(cards, 0) AS cards, coalesce(new, 0) AS new, sum(failed::INT) OVER (ORDER BY page_no) AS failures FROM n LEFT JOIN c USING (page_no)),
        e AS (SELECT page_no, CASE {' '.join(ends)} END AS reason FROM p), stop AS (SELECT min(page_no) AS at_page FROM e WHERE reason IS NOT NULL),
        k AS (SELECT p.* FROM p, stop WHERE at_page IS NULL OR page_no <= at_page)
        SELECT count(*) FILTER (NOT failed) AS pages, coalesce(sum(cards) FILTER (NOT failed), 0)::BIGINT AS cards, coalesce(sum(new) FILTER (NOT failed), 0)::BIGINT AS new_albums,
          count(*) FILTER (failed) AS errors, coalesce((SELECT reason FROM e, stop WHERE page_no = at_page), {at_end}) AS stopped, max(page_no)::BIGINT AS last_page FROM k""",
    )


# D1 to D6: a run over all pages, failed pages that are passed over, five of them, an empty page, a page limit, and a page without news
_discover("discover_fold", "page_no % 100 = 3", "page_no < 0")
_discover("discover_repeated_errors", "page_no % 3 = 0", "page_no < 0")
_discover("discover_empty_page", "page_no = 2", "page_no = 7")
_discover("discover_max_pages", "page_no = 2", "page_no < 0", max_pages=10)
_discover("discover_stop_known", "page_no = 1", "page_no < 0", stop_when_known=True)

# --------------------------------------------------------------------------- scalars

_add("ext_derive", lambda f: f.select("id", scalars.file_extension("search_name").alias("ext"), scalars.file_extension(F.concat(F.lit("a\\b.c/"), F.col("storage"))).alias("ext_path")), ("files",), f"SELECT id, {_EXT.format('search_name')} AS ext, {_EXT.format('storage')} AS ext_path FROM files")
_add(
    "album_id_extract", lambda a: a.select("id", scalars.album_id(F.concat(F.lit(" https://x.invalid/a/"), F.col(ALBUM_KEY), F.lit("?p=1"))).alias("linked"), scalars.album_id(F.concat(F.lit("  "), F.col(ALBUM_KEY))).alias("bare"), scalars.album_id("thumb").alias("neither")), ("albums",),
    f"SELECT id, {ALBUM_KEY} AS linked, {ALBUM_KEY} AS bare, nullif(regexp_extract(thumb, '/a/([A-Za-z0-9]+)', 1), '') AS neither FROM albums",
)
_add(
    "ts_parse", lambda f: f.select("id", scalars.parse_timestamp(F.date_format("uploaded_at", "H:mm:ss d/MM/yyyy")).alias("parsed"), scalars.parse_timestamp("search_name").alias("not_a_time")), ("files",),
    "SELECT id, date_trunc('second', uploaded_at) AS parsed, NULL::TIMESTAMP AS not_a_time FROM files",
)
_add(
    "fmt_size", lambda f: f.select("id", scalars.format_size("size").alias("shown")), ("files",),
    "SELECT id, CASE WHEN coalesce(size, 0) = 0 THEN '' WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN (CASE WHEN size / 1024.0 >= 10 THEN round(size / 1024.0::DOUBLE, 0)::BIGINT::VARCHAR ELSE round(size / 1024.0::DOUBLE, 1)::DECIMAL(12,1)::VARCHAR END) || ' KB'"
    " WHEN size < 1073741824 THEN (CASE WHEN size / 1048576.0 >= 10 THEN round(size / 1048576.0::DOUBLE, 0)::BIGINT::VARCHAR ELSE round(size / 1048576.0::DOUBLE, 1)::DECIMAL(12,1)::VARCHAR END) || ' MB'"
    " ELSE (CASE WHEN size / 1073741824.0 >= 10 THEN round(size / 1073741824.0::DOUBLE, 0)::BIGINT::VARCHAR ELSE round(size / 1073741824.0::DOUBLE, 1)::DECIMAL(12,1)::VARCHAR END) || ' GB' END AS shown FROM files",
)
_add("fmt_date", lambda f: f.select("id", scalars.format_date("uploaded_at").alias("shown")), ("files",), "SELECT id, coalesce(strftime(uploaded_at, '%Y-%m-%d %H:%M'), '') AS shown FROM files")
_add("fmt_time", lambda f: f.select("id", scalars.format_time("uploaded_at").alias("shown")), ("files",), "SELECT id, coalesce(strftime(uploaded_at, '%b %-d, %Y, %-I:%M %p'), '-') AS shown FROM files")
_add("album_url", lambda a: a.select("id", scalars.album_url(ALBUM_KEY, "https://x.invalid/").alias("url")), ("albums",), f"SELECT id, 'https://x.invalid/a/' || {ALBUM_KEY} AS url FROM albums")
_add(
    "retry_after", lambda o: o.withColumns({"status_no": F.when(F.col("rate_limited"), 429).otherwise(200), "header": F.concat(F.lit(" "), F.when(F.col("outcome_id") % 7 == 0, "soon").otherwise(F.col("file_rows").cast("string")))}).select("outcome_id", scalars.retry_after("status_no", "header").alias("wait_s")), ("crawl_outcomes",),
    "SELECT outcome_id, CASE WHEN rate_limited AND outcome_id % 7 <> 0 THEN file_rows::DOUBLE END AS wait_s FROM crawl_outcomes",
)
_add("search_name_coalesce", lambda f: f.select("id", scalars.first_filled("slug", "storage", "search_name").alias("name")), ("files",), "SELECT id, coalesce(nullif(trim(slug), ''), nullif(trim(storage), ''), nullif(trim(search_name), ''), '') AS name FROM files")
_add("first_letter", lambda a: a.select("id", scalars.first_letter("title").alias("letter")), ("albums",), "SELECT id, CASE WHEN coalesce(trim(title), '') = '' THEN '?' ELSE upper(substr(trim(title), 1, 1)) END AS letter FROM albums")
_add("trigrams", lambda a: a.select("id", F.array_join(scalars.trigrams("title"), "|").alias("grams")), ("albums",), "SELECT id, CASE WHEN length(lower(title)) < 3 THEN '' ELSE array_to_string(list_transform(range(1, length(lower(title)) - 1), lambda i: substr(lower(title), i, 3)), '|') END AS grams FROM albums")
_add("sha1_etag", lambda f: f.select("id", scalars.etag("search_name").alias("etag")), ("files",), "SELECT id, '\"' || sha1(search_name) || '\"' AS etag FROM files")
_add("base64url", lambda f: f.select("id", scalars.base64url("slug").alias("token")), ("files",), "SELECT id, replace(replace(replace(to_base64(encode(slug)), '+', '-'), '/', '_'), '=', '') AS token FROM files")

# --------------------------------------------------------------------------- sources and streams

_STRIP = r"regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}\x{{85}}\x1c-\x1f]+|[\s\p{{Z}}\x{{85}}\x1c-\x1f]+$', '', 'g')"
_NAME = _STRIP.format("search_name")
_add(
    "parse_album_page",
    lambda f: pages.album_files(pages.album_pages(pages.album_page_of(f), "page_key"), "page_key").select("file_id", F.substring_index("album_id", "/", 1).alias("album_id"), "search_name", "storage", "slug", "media", "size", "uploaded_at"), ("files",),
    f"""SELECT file_id, album_id, CASE WHEN {_NAME} <> '' THEN {_NAME} WHEN {_STRIP.format('slug')} <> '' THEN {_STRIP.format('slug')} ELSE {_STRIP.format('storage')} END AS search_name,
    {_STRIP.format('storage')} AS storage, {_STRIP.format('slug')} AS slug, coalesce(media, '') AS media, greatest(coalesce(size, 0), 0) AS size, date_trunc('second', uploaded_at) AS uploaded_at FROM files""",
)


def _safe(column: str) -> F.Column:
    return F.replace(F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def _titles(albums: DataFrame) -> DataFrame:
    """Titles of pages: those of even albums from the property, those of odd ones from the title with tags and the site's name."""
    even = F.concat(F.lit('<head><meta content="'), _safe("title"), F.lit('" property="og:title"><meta property="og:image" content="'), _safe("thumb"), F.lit('"></head>'))
    odd = F.concat(F.lit("<title> <b>"), _safe("title"), F.lit("</b> | site</title>"))
    page = albums.select("id", F.when(F.col("id") % 2 == 0, even).otherwise(odd).alias("html"))
    return pages.album_pages(page, "id").select(F.col("id").cast("long").alias("id"), "title", "thumb", "blob", "parse_error")


def _listing(cards: DataFrame) -> DataFrame:
    safe = _safe
    card = F.concat(F.lit('<a class="c" href="https://x.invalid/a/'), F.col(ALBUM_KEY), F.lit('"><img class="thumb-img" src="'), safe("thumb"), F.lit('" alt="'), safe("title"), F.lit('"> '), F.coalesce("file_count", F.lit(0)).cast("string"), F.lit(" files</a>"))
    page = cards.select("page_no", "card_id", card.alias("card")).groupBy("page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("card_id", "card"))), lambda x: x["card"]), "\n").alias("html"))
    return pages.listing_cards(page).select("page_no", ALBUM_KEY, "url", "title", "thumb", "file_count")


_add(
    "parse_listing", _listing, ("discovery_cards",),
    f"SELECT page_no::BIGINT AS page_no, {ALBUM_KEY}, 'https://x.invalid/a/' || {ALBUM_KEY} AS url, {_STRIP.format('arg_min(title, card_id)')} AS title, arg_min(thumb, card_id) AS thumb, arg_min(coalesce(file_count, 0), card_id) AS file_count FROM discovery_cards GROUP BY 1, 2",
)


_add(
    "page_title", _titles, ("albums",),
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN {_STRIP.format('title')} ELSE {_STRIP.format("split_part(title, '|', 1)")} END AS title, CASE WHEN id % 2 = 0 THEN thumb ELSE '' END AS thumb,
    false AS blob, false AS parse_error FROM albums""",
)


def _stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily arrivals of discovery cards from a stream with a watermark, the days that are still open included."""
    source = f"{sf_dir}/discovery_cards.parquet"
    schema = spark.read.parquet(source).schema
    out = shared_path(spark, "arrivals")
    stream = ingest.arrivals(spark.readStream.schema(schema).parquet(f"{source}*"), late="30 days")
    query = stream.writeStream.outputMode("update").foreachBatch(ingest.upsert_windows(out)).option("checkpointLocation", shared_path(spark, "arrivals-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return ingest.windows(spark, out).select(F.unix_micros("start").alias("start_us"), "cards")


def _stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All albums of a catalog after a stream of all discovery cards was merged into it, batch by batch."""
    source = f"{sf_dir}/discovery_cards.parquet"
    root = shared_path(spark, "catalog")
    catalog = Catalog(spark, root)
    catalog.create()
    catalog.commit({"albums": _t(spark, sf_dir, "albums")})
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")
    ingest.follow(_with_new(stream, "card_id"), ingest.commit_cards(catalog, AS_OF), f"{root}-state").awaitTermination()
    return _shown(catalog.read("albums"))


_QUERIES["stream_merge"], _SQL["stream_merge"] = _stream_merge, _SQL["upsert_discovered"]
_QUERIES["stream_arrivals"] = _stream_arrivals
_SQL["stream_arrivals"] = f"""SELECT epoch_us(date_trunc('day', seen_at)) AS start_us, count(*) AS cards
FROM (SELECT DISTINCT {ALBUM_KEY}, page_no, seen_at FROM discovery_cards) GROUP BY 1"""


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
