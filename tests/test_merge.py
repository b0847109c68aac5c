from datetime import datetime

import pytest

from tesserae.operators import merge as M
from tesserae.operators import state as T
from tesserae.sources.schema import ALBUM_KEY, ALBUMS, FILES, Catalog, conform
from tesserae.streaming import ingest

AS_OF = "2024-06-01 12:00:00"


def albums_of(spark, rows):
    """rows: id, key, title, thumb, indexed, attempts, dead"""
    df = spark.createDataFrame(rows, f"id long, {ALBUM_KEY} string, title string, thumb string, indexed string, attempts int, dead int")
    return conform(df.selectExpr("*", "CAST(indexed AS TIMESTAMP) AS indexed_at", "TIMESTAMP '2024-01-01' AS discovered_at", "TIMESTAMP '2024-01-01' AS updated_at", "7L AS file_count", "'' AS last_error"), ALBUMS)


@pytest.fixture
def albums(spark):
    return albums_of(spark, [(1, "a", "A", "t", "2024-05-02 00:00:00", 0, 0), (2, "b", "B", "", None, 5, 0), (3, "c", "C", "", None, 0, 1), (4, "d", "D", "", None, 1, 0)])


def by_key(df):
    return {r[ALBUM_KEY]: r for r in df.collect()}


def test_discovery_upsert(spark, albums):
    cards = spark.createDataFrame([(1, "x", "X1", None, "u"), (2, "a", "A2", 9, ""), (3, "x", "X2", 4, ""), (4, "y", None, 1, None)], f"pos long, {ALBUM_KEY} string, title string, file_count long, thumb string")
    out = by_key(M.upsert_discovered(albums, cards, AS_OF, ["pos"]))
    assert (out["a"]["title"], out["a"]["file_count"], out["a"]["thumb"]) == ("A2", 9, "t")
    assert out["a"]["updated_at"] == datetime(2024, 1, 1)
    assert (out["x"]["id"], out["x"]["title"], out["x"]["file_count"], out["x"]["thumb"]) == (5, "X2", 4, "u")
    assert out["y"]["id"] == 6 and out["y"]["title"] == "" and len(out) == 6
    assert M.count_new(albums, cards).first()[0] == 3  # the repeated one counts twice
    assert M.upsert_discovered(albums, cards.limit(0), AS_OF, ["pos"]).count() == 4


def test_pending_resets(spark, albums):
    ids = spark.createDataFrame([("b", 0), ("", 1), (None, 2), ("z", 3), ("a", 4)], f"{ALBUM_KEY} string, pos long")
    out = by_key(M.set_pending(albums, ids, AS_OF))
    assert (out["b"]["attempts"], out["b"]["dead"], out["a"]["indexed_at"]) == (0, 0, None)
    assert out["z"]["title"] == "" and out["z"]["id"] == 5 and len(out) == 5


def test_replace_and_duplicates(spark, albums):
    files = spark.createDataFrame([(10, "a", 1, "old.jpg")], "id long, album_id string, file_id long, search_name string")
    files = conform(files, FILES)
    new = spark.createDataFrame([("a", 7, "n.PNG", 0), ("a", 8, "m", 1), ("e", 7, "x.gz", 2), ("d", 7, "p", 3), ("d", 7, "q", 4)], "album_id string, file_id long, search_name string, pos long")
    new = new.selectExpr("*", "'' AS extension", "CAST(NULL AS LONG) AS size")
    sound, twice = M.split_duplicates(new)
    assert [r[0] for r in twice.collect()] == ["d"]
    out = {(r["album_id"], r["file_id"]): r for r in M.replace_files(files, sound, sound.select("album_id")).collect()}
    assert set(out) == {("a", 7), ("a", 8), ("e", 7)} and out["a", 7]["extension"] == "png" and out["a", 8]["size"] == 0
    assert sorted(r["id"] for r in out.values()) == [11, 12, 13]
    parsed = spark.createDataFrame([("a", "T", "", 0), ("e", "E", "i", 1)], f"{ALBUM_KEY} string, title string, thumb string, pos long")
    counts = spark.createDataFrame([("a", 2), ("e", 1)], "album_id string, n long")
    after = by_key(M.replace_albums(albums, parsed, counts, AS_OF))
    assert (after["a"]["file_count"], after["a"]["thumb"], after["e"]["file_count"]) == (2, "t", 0)


def test_errors(spark, albums):
    bad = spark.createDataFrame([("a", "x" * 900, False), ("b", None, True), ("no", "", True)], f"{ALBUM_KEY} string, message string, dead boolean")
    out = by_key(M.mark_errors(albums, bad, AS_OF))
    assert len(out["a"]["last_error"]) == 500 and out["a"]["attempts"] == 1 and out["a"]["dead"] == 0 and out["a"]["indexed_at"] is not None
    assert (out["b"]["attempts"], out["b"]["dead"], out["b"]["indexed_at"]) == (6, 1, None) and "no" not in out


def test_queue_and_staleness(albums):
    assert [r[ALBUM_KEY] for r in T.pending(albums, AS_OF).collect()] == ["d"]
    assert [r[ALBUM_KEY] for r in T.pending(albums, AS_OF, stale_days=29).collect()] == ["d", "a"]
    assert T.pending_count(albums, AS_OF, 30).first()[0] == 1  # the day itself is not stale
    s = T.stats(albums, albums.limit(0)).first()
    assert (s["albums_total"], s["albums_indexed"], s["albums_dead"], s["albums_pending"], s["albums_stuck"], s["files"]) == (4, 1, 1, 1, 1, 0)


def test_delete_and_extensions(spark, albums):
    files = conform(spark.createDataFrame([(1, "a", "dir.d/file"), (2, "c", "a.tar.GZ"), (3, "b", ".bashrc"), (4, "b", "a."), (5, "b", "a.b c"), (6, "b", "x\\y.ZIP"), (7, "b", None)], "id long, album_id string, search_name string"), FILES)
    left, kept = M.delete_albums(albums, files, albums.filter(f"{ALBUM_KEY} = 'c'"))
    assert left.count() == 3 and 2 not in {r["id"] for r in kept.collect()}
    assert {r["id"]: r["extension"] for r in M.backfill_extension(files).collect()} == {1: "", 2: "gz", 3: "bashrc", 4: "", 5: "", 6: "zip", 7: ""}


def test_discovery_fold(spark, albums):
    cards = spark.createDataFrame([(1, 0, "n1"), (1, 1, "n1"), (1, 2, "a"), (3, 0, "n2"), (4, 0, "a"), (5, 0, "n3")], f"page_no long, pos long, {ALBUM_KEY} string")
    pages = lambda failed, last: spark.createDataFrame([(p, p in failed) for p in range(1, last + 1)], "page_no long, failed boolean")
    fold = lambda *a, **k: T.fold_pages(*a, cards, albums, **k).first()[:]
    assert fold(pages({2}, 5)) == (4, 5, 3, 1, "pages_exhausted", 5)
    assert fold(pages({2}, 5), stop_when_known=True) == (3, 4, 2, 1, "all_known", 4)
    assert fold(pages(set(), 5)) == (2, 2, 1, 0, "empty_page", 2)
    assert fold(pages({2}, 5), max_pages=3) == (2, 3, 2, 1, "max_pages", 3)
    assert fold(pages({6, 7, 8, 9, 10, 11, 2}, 12))[4:] == ("repeated_errors", 9)


def test_breaker_and_classification(spark):
    kinds = ["error"] * 6 + ["dead", "error", "error", "error", "ok", "error"]
    limited = [True] * 6 + [False, True, True, True, False, True]
    rows = [(i, k, r, f"2024-01-{1 + i // 3:02d} 0{i % 3}:00:00") for i, (k, r) in enumerate(zip(kinds, limited, strict=True))]
    outcomes = spark.createDataFrame(rows, "outcome_id long, status string, rate_limited boolean, at string").selectExpr("*", "CAST(at AS TIMESTAMP) AS fetched_at")
    pauses = {r["outcome_id"]: r["pause_s"] for r in T.breaker_log(outcomes.repartition(3), 10, 25, 2).collect()}
    assert pauses == {0: 0, 1: 10, 2: 0, 3: 20, 4: 0, 5: 25, 7: 0, 8: 10, 9: 0, 11: 0}
    assert T.breaker_log(outcomes.limit(0)).count() == 0
    log = spark.createDataFrame([("a", 1, 503, False), ("a", 2, 200, True), ("b", 1, 404, False), ("b", 2, 200, True), ("c", 1, 429, False), ("c", 2, 503, False), ("d", 1, 200, False), ("d", 2, 403, False), ("e", 1, None, False)], f"{ALBUM_KEY} string, attempt_no int, http_status int, has_files boolean")
    assert {r[0]: r[1:] for r in T.classify_attempts(log).collect()} == {"a": ("ok", False), "b": ("dead", False), "c": ("error", True), "d": ("error", False), "e": ("error", False)}


def test_outcome_log_in_any_order(spark, albums):
    rows = [(1, "a", "error", "e1", "2024-02-01"), (2, "a", "ok", "", "2024-02-03"), (3, "a", "error", "late", "2024-02-02"), (4, "d", "dead", "gone", "2024-02-01"), (5, "d", "dead", "gone", "2024-02-01")]
    log = spark.createDataFrame(rows, f"outcome_id long, {ALBUM_KEY} string, status string, message string, day string").selectExpr("*", "false AS rate_limited", "3L AS file_rows", "false AS parse_error", "CAST(day AS TIMESTAMP) AS fetched_at", "CAST(day AS TIMESTAMP) AS arrived_at").drop("day")
    out = by_key(M.apply_outcomes(albums, log))
    assert (out["a"]["attempts"], out["a"]["last_error"], out["a"]["file_count"]) == (0, "", 3)
    assert (out["d"]["attempts"], out["d"]["dead"]) == (2, 1)


PAGE = '<title>T &amp; x | site</title><script>window.albumFiles = [\n{\n id: %d,\n name: "a.jpg",\n original: "x];y.jpg",\n size: 5,\n timestamp: "1:02:03 31/01/2024"\n}];</script>'


def test_stream_of_pages(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.create()
    landing = str(tmp_path / "landing")
    double = "window.albumFiles = [\n{ id: 1 },\n{\nid: 2\n},{\nid: 2\n}]"
    spark.createDataFrame([("k1", PAGE % 4), ("k2", "no array"), ("k3", double)], f"{ALBUM_KEY} string, html string").write.parquet(landing)
    commit = ingest.commit_pages(catalog, AS_OF)
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.landed(spark, landing, f"{ALBUM_KEY} string, html string")
        ingest.follow(stream, commit, str(tmp_path / "state")).awaitTermination()
    files, albums = catalog.read("files").collect(), by_key(catalog.read("albums"))
    assert [(r["search_name"], r["size"], r["extension"], r["uploaded_at"]) for r in files] == [("x];y.jpg", 5, "jpg", datetime(2024, 1, 31, 1, 2, 3))]
    assert albums["k1"]["title"] == "T & x" and set(albums) == {"k1"}


def test_stream_of_cards_and_empty_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.create()
    catalog.create()
    assert catalog.read("files").count() == 0 and catalog.bytes() > 0
    cards = spark.createDataFrame([(1, "k", "t", 2, "u", "2024-01-01")], f"card_id long, {ALBUM_KEY} string, title string, file_count long, thumb string, d string").selectExpr("*", "CAST(d AS TIMESTAMP) AS seen_at")
    ingest.commit_cards(catalog, AS_OF)(cards, 0)
    ingest.commit_cards(catalog, AS_OF)(cards, 0)
    assert [(r["id"], r["title"]) for r in catalog.read("albums").collect()] == [(1, "t")]
