import math
import re
from datetime import datetime

import pytest

from tesserae.operators import index
from tesserae.operators import search as S
from tesserae.sources.schema import ALBUM_KEY, ALBUMS, FILES, conform

NAMES = [
    (1, "one two three audition five.mp4", "capture-raw-001.mp4", "audition-clip", "Video", 10, "2024-01-01"),
    (2, "Alpha first.jpg", "", "", "Image", 20, "2024-02-01"), (3, "ALPHA latest.jpg", "", "", "Image", 30, "2024-03-01"),
    (4, "Alpha last.jpg", "", "", "GIF", 40, "2024-04-01"), (5, "model-2025_final.jpg", "", "", "", 40, None), (6, "it's (odd) & é.zip", "", "", "Other", None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, "A1", i, n, st, sl, "", m, n.rsplit(".")[-1], z, t and datetime.fromisoformat(t)) for i, n, st, sl, m, z, t in NAMES]
    files = spark.createDataFrame(rows, FILES)
    albums = spark.createDataFrame([(1, "A1", "Album one"), (2, "B2", "abcabcab"), (3, "C3", ""), (4, "D4", "xabcx")], f"id long, {ALBUM_KEY} string, title string")
    albums = conform(albums.selectExpr("*", "0 AS dead", "0 AS attempts", "TIMESTAMP '2024-01-01' AS discovered_at", "TIMESTAMP '2024-01-02' AS indexed_at"), ALBUMS)
    return files, albums


def ids(out):
    return [r["id"] for r in out["results"]]


def test_aliases_words_phrases(tables):
    f, a = tables
    assert ids(S.search_files(f, a, "capture-raw")) == [1]
    assert ids(S.search_files(f, a, "audition three")) == [1]
    assert ids(S.search_files(f, a, '"three two"')) == []
    assert ids(S.search_files(f, a, "model.2025-final")) == [5]
    assert ids(S.search_files(f, a, "it's")) == [6] and ids(S.search_files(f, a, "(odd)")) == [6]


def test_folding_is_ascii_only(tables):
    f, a = tables
    assert ids(S.search_files(f, a, "ALPHA", sort="newest")) == [4, 3, 2]
    assert ids(S.search_files(f, a, "& É.ZIP")) == [6]  # the query is lowered, the names by ASCII only


def test_filters_orders_and_pages(tables):
    f, a = tables
    assert ids(S.search_files(f, a, "alpha", extension="jpg", sort="newest")) == [4, 3, 2]
    one = S.search_files(f, a, "al", sort="newest", limit=2)
    assert (ids(one), one["mode"], one["has_more"]) == ([4, 3], "prefix", True)
    two = S.search_files(f, a, "al", sort="newest", limit=2, cursor=one["next_cursor"])
    assert (ids(two), two["has_more"], two["next_cursor"]) == ([2], False, None)
    assert ids(S.search_files(f, a, media="image")) == [4, 3, 2] and ids(S.search_files(f, a, media="other")) == [6, 5]
    with pytest.raises(ValueError, match="1-16"):
        S.search_files(f, a, extension="jpg!")


@pytest.mark.parametrize(("q", "sort"), [("", "newest"), ("", "oldest"), ("", "size"), ("al", "relevance"), ("alpha", "relevance")])
def test_walking_by_cursor_gives_every_row_once(tables, q, sort):
    f, a = tables
    whole, walked, cursor = ids(S.search_files(f, a, q, sort=sort, limit=100)), [], None
    while True:
        page = S.search_files(f, a, q, sort=sort, limit=2, cursor=cursor)
        walked += ids(page)
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert walked == whole and len(whole) == len(set(whole))


def test_cap(tables):
    f, a = tables
    assert S.capped_total(S.file_hits(f), 6).first()[:] == (6, False)
    assert S.capped_total(S.file_hits(f), 5).first()[:] == (5, True)


def test_orphans_are_counted_but_not_shown(tables):
    f, a = tables
    out = S.search_files(f, a.filter("id > 1"), "alpha")
    assert out["total"] == 3 and out["results"] == []


def test_bm25_against_the_formula(tables):
    _, a = tables
    got = {r["id"]: r["score"] for r in S.title_hits(a, "abc").collect()}
    n, lengths = 4, {1: 7, 2: 6, 3: 0, 4: 3}
    idf = max(math.log((n - 2 + 0.5) / 2.5), 0) or 1e-6
    want = {i: -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / (sum(lengths.values()) / n))) for i, tf in ((2, 2), (4, 1))}
    assert got == pytest.approx(want)


def test_albums_and_random(tables):
    f, a = tables
    assert [r["real_files"] for r in S.browse(a, f).collect()] == [0, 0, 0, 6]
    assert S.search_albums(a, f, "")["total"] == 0 and S.search_albums(a, f, "Al")["total"] == 1
    assert S.random_album(a, f, 1).first()["id"] == 1
    assert S.random_album(a.filter("id = 3"), f).isEmpty()


def test_stored_index(spark, tables, tmp_path):
    f, _ = tables
    path = str(tmp_path / "index")
    index.write(f, path)
    found = {r["id"] for r in index.candidates(spark, path, "alpha").collect()}
    exact = lambda q: {r["id"] for r in S.file_hits(f, q).collect()}
    through = lambda q: {r["id"] for r in index.search(spark, path, q).collect()}
    assert exact("alpha") <= found and all(through(q) == exact(q) for q in ("alpha", "al", '"alpha first"', "zzz", ""))
    first = f.filter("id = 2")
    index.add(first.limit(0), path, 1, first)  # the first file is no longer what it was
    gone = first.first()["id"]
    assert {r["id"] for r in index.candidates(spark, path, "alpha").collect()} == found - {gone}
    assert gone not in {r["id"] for r in index.names(spark, path).collect()}
    index.add(first, path, 2)
    index.add(first, path, 2)  # run again
    assert all(through(q) == exact(q) for q in ("alpha", "al", ""))
    assert {r["id"] for r in index.candidates(spark, path, "alpha").collect()} == found


def test_substring_search_stays_in_generated_code(tables):
    f, _ = tables
    plan = S.file_hits(f, '"silver mirror" alpha')._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\*\(\d+\) Filter", plan) and "lambda" not in plan


def test_trigrams_of_a_very_long_name(spark):
    import time

    from pyspark.sql import functions as F

    from tesserae.functions.scalars import trigrams

    rows = spark.createDataFrame([("Añ😀b",), ("ab",), ("",), (None,), ("xyz" * 60_000,)], "v string")
    began = time.perf_counter()
    got = [r[0] for r in rows.select(F.when(F.char_length("v") < 9, trigrams("v")).otherwise(F.array(F.size(trigrams("v")).cast("string")))).collect()]
    assert got == [["añ😀", "ñ😀b"], [], [], ["0"], ["179998"]] and time.perf_counter() - began < 20
