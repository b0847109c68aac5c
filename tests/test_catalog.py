"""Versions of the catalog: what writers that meet, die or come again leave behind."""

import os
from datetime import datetime

import pytest

from tesserae.functions.storage import Conflict, Pointers
from tesserae.sources.schema import ALBUM_KEY, META, Catalog
from tesserae.streaming import ingest


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    c.create()
    return c


def meta(spark, *rows):
    return spark.createDataFrame(list(rows), META)


def keys(catalog):
    return {r["key"] for r in catalog.read("meta").collect()}


def test_a_writer_that_dies_leaves_the_old_version(spark, catalog, monkeypatch):
    before = keys(catalog)
    monkeypatch.setattr(Pointers, "_create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        catalog.commit({"meta": meta(spark, ("x", "1"))})
    monkeypatch.undo()
    assert keys(catalog) == before
    # dead half-way through the pointer file: its number is passed over
    number = catalog.pointers.latest()[0]
    open(f"{catalog.root}/_pointers/{number + 1:010d}.json", "w").write('{"tables": {')
    assert keys(catalog) == before
    catalog.create()
    catalog.commit({"meta": meta(spark, ("x", "1"))})
    assert keys(catalog) == {"x"} and catalog.pointers.latest()[0] == number + 2


def test_two_writers(spark, catalog):
    base = catalog.pointers.latest()[0]
    catalog.commit({"meta": meta(spark, ("one", "1"))}, base)
    with pytest.raises(Conflict):
        catalog.commit({"meta": meta(spark, ("two", "2"))}, base)
    assert keys(catalog) == {"one"}
    calls = []

    def add(tables):
        calls.append(1)
        if len(calls) == 1:  # another writer comes between reading and publishing
            catalog.commit({"meta": meta(spark, ("one", "1"), ("other", "3"))})
        return {"meta": tables["meta"].unionByName(meta(spark, ("mine", "4")))}

    assert catalog.update(add) and len(calls) == 2
    assert keys(catalog) == {"one", "other", "mine"}
    number = catalog.pointers.latest()[0] + 1
    catalog.pointers._create(number, b"")
    with pytest.raises(Conflict):
        catalog.pointers._create(number, b"{}")


def test_create_refuses_a_damaged_store(spark, catalog):
    for name in os.listdir(f"{catalog.root}/_pointers"):
        os.remove(f"{catalog.root}/_pointers/{name}")
    with pytest.raises(RuntimeError, match="no pointer"):
        catalog.create()


def test_vacuum(spark, catalog):
    catalog.commit({"meta": meta(spark, ("a", "1"))})
    assert catalog.vacuum() == 1 and keys(catalog) == {"a"}


PAGE = "<title>%s</title>window.albumFiles = [{id: 1, name: 'a.jpg'}]"


def test_batches_that_come_again_change_nothing(spark, catalog):
    schema = f"{ALBUM_KEY} string, html string, arrived_at timestamp"
    bad = spark.createDataFrame([("k", "no list", datetime(2024, 1, 1))], schema)
    good = spark.createDataFrame([("k", PAGE % "zz old", datetime(2024, 1, 1)), ("k", PAGE % "new", datetime(2024, 1, 2))], schema)
    commit = ingest.commit_pages(catalog, "2024-06-01 00:00:00")
    commit(good, 0)
    assert catalog.read("albums").first()["title"] == "new"  # the latest page, not the greatest text
    commit(bad, 1)
    commit(bad, 1)
    row = catalog.read("albums").first()
    assert row["attempts"] == 1 and row["last_error"] and catalog.read("files").count() == 1


def test_sync(spark, tmp_path, catalog):
    cards, pages = str(tmp_path / "cards"), str(tmp_path / "pages")
    spark.createDataFrame([(1, "k", "t", 2, "u", datetime(2024, 1, 1))], f"card_id long, {ALBUM_KEY} string, title string, file_count long, thumb string, seen_at timestamp").write.parquet(cards)
    spark.createDataFrame([("k", PAGE % "T")], f"{ALBUM_KEY} string, html string").write.parquet(pages)
    read = lambda path, schema: ingest.landed(spark, path, schema)
    cycle = lambda: ingest.sync(
        catalog, read(cards, f"card_id long, {ALBUM_KEY} string, title string, file_count long, thumb string, seen_at timestamp"),
        read(pages, f"{ALBUM_KEY} string, html string"), str(tmp_path / "state"), "2024-06-01 00:00:00",
    )
    assert cycle() == cycle() == {"albums_total": 1, "albums_indexed": 1, "files": 1}
    slept, clock = [], iter([0.0, 60.0, 100.0, 8000.0, 9000.0, 9000.0])
    calls = []
    ingest.sync_every(lambda: calls.append(1) or 1 / 0, 2, 3, lambda: next(clock), slept.append)
    assert len(calls) == 3 and slept == [7140.0, 0.0]


def test_migration(spark, catalog):
    from tesserae.operators.migrate import migrate

    assert not migrate(catalog)
    # a store of the first version: no mark, files without their extension
    spark.createDataFrame([(1, "A", 7, "x.PNG")], "id long, album_id string, file_id long, search_name string").write.parquet(f"{catalog.root}/files/v-old")
    number, content = catalog.pointers.latest()
    catalog.commit({"meta": meta(spark, ("page_cursor", "3"))})
    number, content = catalog.pointers.latest()
    content["tables"]["files"] = "files/v-old"
    catalog.pointers.publish(content, number)
    assert migrate(catalog) and not migrate(catalog)
    assert catalog.read("files").first()["extension"] == "png"
    assert {r["key"]: r["value"] for r in catalog.read("meta").collect()} == {"page_cursor": "3", "schema_version": "3", "extension_backfill": "done"}
    catalog.commit({"meta": meta(spark, ("schema_version", "9"))})
    with pytest.raises(RuntimeError, match="schema 9"):
        migrate(catalog)
