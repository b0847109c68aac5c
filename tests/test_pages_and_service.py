import json

import pytest

from tesserae.cli import main
from tesserae.functions import scalars
from tesserae.service import Cache, Options, Pager, Service, etag_matches, etag_of
from tesserae.sources import pages as P
from tesserae.sources.schema import ALBUM_KEY, Catalog

ITEM = 'window.albumFiles = [\n{\n  id: 5,\n  name: "st\\u006fre.mp4",\n  original: "a \\"q\\" ]; {b}.mp4",\n  slug: "sl",\n  type: "video/mp4",\n  extension: "Video",\n  size: 12,\n  timestamp: "01:02:03 31/01/2024"\n},\n{\n  id: 6,\n  name: "only.bin"\n}\n];'


def test_album_page():
    page = P.parse_album(f'<meta property="og:title" content=" A &amp; B "><meta property="og:image" content="i.png"><script>{ITEM}</script>')
    assert (page["title"], page["thumb"], page["blob"], page["parse_error"]) == ("A & B", "i.png", True, False)
    one, two = page["files"]
    assert one == {"file_id": 5, "storage": "store.mp4", "original": 'a "q" ]; {b}.mp4', "slug": "sl", "mime": "video/mp4", "media": "Video", "size": 12, "uploaded_at": "2024-01-31T01:02:03", "search_name": 'a "q" ]; {b}.mp4'}
    assert two["search_name"] == "only.bin" and two["uploaded_at"] is None


@pytest.mark.parametrize(("text", "blob", "error"), [("", False, False), ("window.albumFiles = [", False, True), ('window.albumFiles = ["x', False, True), ("window.albumFiles = []", True, False), ("window.albumFiles = [{id: x}]", True, True)])
def test_array_states(text, blob, error):
    page = P.parse_album(text)
    assert (page["blob"], page["parse_error"], page["files"]) == (blob, error, [])


def test_title_fallback_and_times():
    assert P.parse_album("<title>My <b>x</b> | host</title>")["title"] == "My x"
    assert [P._time(t) for t in ("01:02:03 31/01/2024", "", "not a date", "2024-01-01", "99:99:99 99/99/9999")] == ["2024-01-31T01:02:03", None, None, None, None]


def test_listing():
    page = (
        '<a class="c" href="https://h/a/AA1"><img alt="T &amp; u" class="x thumb-img" src="s.png"> 3 files, then 12 files</a>'
        '<a href="https://h/a/AA1">again</a><a href="/a/BB2"><p>View album Some  name - 1 file</p> → Open</a><a href="/b/CC">no</a>'
    )
    assert P.parse_listing(page) == [
        {"url": "https://h/a/AA1", ALBUM_KEY: "AA1", "title": "T & u", "thumb": "s.png", "file_count": 12},
        {"url": "/a/BB2", ALBUM_KEY: "BB2", "title": "Some name", "thumb": "", "file_count": 1},
    ]


def test_ids(spark):
    raw = ["https://h/a/Ab1?x", " Ab1 ", "", "not an id!!", "https://example.com/", "a]b", "../../etc", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").select("i", scalars.album_id("raw").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == ["Ab1", "Ab1", None, None, None, None, None, None]


def test_read_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text("<title>x</title>\n" + ITEM)
    pages = P.read_pages(spark, str(tmp_path)).withColumnRenamed("path", ALBUM_KEY)
    assert P.album_files(P.album_pages(pages)).count() == 2


def test_cache_and_etags():
    now = [0.0]
    c = Cache(2, 10, lambda: now[0])
    built = []
    get = lambda key: c.body(key, lambda: built.append(key) or key.encode())
    assert [get(k)[1] for k in "abac"] == [False, False, True, False]
    assert [get("a")[1], get("c")[1], get("b")[1], "".join(built)] == [True, True, False, "abcb"]
    now[0] = 10.0
    assert get("b") == (b"b", False)
    c.clear()
    assert get("b") == (b"b", False) and get("b") == (b"b", True)
    with pytest.raises(ZeroDivisionError):
        c.body("x", lambda: 1 / 0)
    assert c.body("x", lambda: b"1") == (b"1", False)
    assert c.body("y", lambda: c.clear() or b"old") == (b"old", False) and not get("y")[1]
    tag = etag_of(b"x")
    assert etag_matches(f'"no", W/{tag}', tag) and not etag_matches('"no"', tag)


def test_pager():
    p = Pager()
    assert not p.forward(None) and p.forward("c1") and p.current() == "c1" and p.back() and p.current() is None and not p.back()


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("service"))
    catalog = Catalog(spark, root)
    catalog.create()
    albums = spark.createDataFrame([(1, "A1", "First album", 0), (2, "B2", "Dead album", 1)], f"id long, {ALBUM_KEY} string, title string, dead int").selectExpr("*", "0 AS attempts", "current_timestamp() AS discovered_at", "current_timestamp() AS indexed_at")
    files = spark.createDataFrame([(i, "A1", i, f"name {i}.jpg") for i in range(1, 6)], "id long, album_id string, file_id long, search_name string")
    catalog.commit({"albums": albums, "files": files})
    return Service(spark, Options(root, admin_token="s3"))


def test_requests(service):
    status, head, body = service.search("name", per=2)
    assert status == 200 and head["X-Cache"] == "miss" and json.loads(body)["total"] == 5
    assert service.search("name", per=2)[1]["X-Cache"] == "hit"
    assert service.search("name", per=2, if_none_match=head["ETag"])[0] == 304
    cursor = json.loads(body)["next_cursor"]
    assert service.search("other", cursor=cursor)[0] == 400 and service.search("name", per=2, cursor=cursor)[0] == 200
    for bad in ({"per": 101}, {"page": 0}, {"sort": "x"}, {"media": "x"}, {"ext": ".jpg"}, {"q": "x" * 201}):
        assert service.search(**bad)[0] == 400
    assert [r["title"] for r in json.loads(service.albums()[2])["results"]] == ["First album"]
    assert json.loads(service.albums("Dead")[2])["total"] == 1
    assert service.random_album()[0] == 200 and json.loads(service.stats()[2])["files"] == 5


def test_mutations(service):
    now = "2024-01-01 00:00:00"
    assert service.add(["https://h/a/N1"], now)[0] == 401
    admin = {"Authorization": "Bearer s3"}
    assert service.add([], now, admin)[0] == 400 and service.add(["x"], now, admin)[0] == 400
    assert json.loads(service.add(["https://h/a/N1"], now, admin)[2]) == {"accepted": ["N1"]}
    assert service.delete("none", {"x-admin-token": "s3"})[0] == 404
    assert service.delete("A1", {"x-admin-token": "s3"})[0] == 200
    assert json.loads(service.search("name", per=2)[2])["total"] == 0


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "cat")
    assert main(["--root", root, "add", "https://h/a/Q1", "bad!"], spark) == 0
    assert main(["--root", root, "queue"], spark) == 0
    assert main(["--root", root, "stats"], spark) == 0
    assert main(["--root", root, "search", "--sort", "odd"], spark) == 1
    out = capsys.readouterr().out
    assert "1 enqueued" in out and "Q1" in out and "albums_pending" in out


def test_empty_pages_table(spark):
    empty = spark.createDataFrame([], f"{ALBUM_KEY} string, html string")
    assert P.album_files(P.album_pages(empty)).count() == 0


def test_script_objects():
    read = P.parse_album(r"""window.albumFiles=[{ id : 7, "name":'it\'s 😀.jpg', nested: {id: 9, name: "no"}, list: ["id: 3", {id: 4}], size: -5, size: 12 }, {name: "no id"}, /* x */ {id: 08}] ; more = {id: 5}""")
    assert [(f["file_id"], f["storage"], f["size"]) for f in read["files"]] == [(7, "it's 😀.jpg", 12), (8, "", 0)] and not read["parse_error"]
    assert P.script_text(r"a\\b\"c\n\x41é\q") == 'a\\b"c\nAéq'


def test_listing_without_closing_tags():
    cards = P.parse_listing('<a href="/a/A1">One 2 FILES<a href="/a/B2">profiles 3 files</a><a href="/a/C3">x')
    assert [(c[ALBUM_KEY], c["title"], c["file_count"]) for c in cards] == [("A1", "One", 2), ("B2", "profiles", 3), ("C3", "x", 0)]
    assert P.parse_listing("") == [] and P.parse_album("") == {"title": "", "thumb": "", "files": [], "blob": False, "parse_error": False}


def test_options_from_the_environment():
    o = Options.from_environment("r", {"TESSERAE_CACHE_SECONDS": "5", "TESSERAE_MOST_PER_PAGE": "7", "OTHER": "x"})
    assert (o.root, o.cache_seconds, o.most_per_page, o.longest_query) == ("r", 5.0, 7, 200)


def test_albums_command_prints_lines(spark, service, capsys):
    root = service.options.root
    assert main(["--root", root, "albums", "--per", "500"], spark) == 1
    assert main(["--root", root, "albums"], spark) == 0
    assert not capsys.readouterr().out.splitlines()[-1].startswith("{")
