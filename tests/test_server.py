"""The interface over HTTP, end to end."""

import http.client
import json
import threading

import pytest

from tesserae.server import serve
from tesserae.service import Options, Service
from tesserae.sources.schema import ALBUM_KEY, Catalog


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("served"))
    catalog = Catalog(spark, root)
    catalog.create()
    albums = spark.createDataFrame([(1, "A1", "First album", 0), (2, "B2", "Dead album", 1)], f"id long, {ALBUM_KEY} string, title string, dead int").selectExpr("*", "0 AS attempts", "current_timestamp() AS discovered_at", "current_timestamp() AS indexed_at")
    files = spark.createDataFrame([(i, "A1", i, f"name {i}.jpg", "jpg") for i in range(1, 6)], "id long, album_id string, file_id long, search_name string, extension string")
    catalog.commit({"albums": albums, "files": files})
    server = serve(Service(spark, Options(root, admin_token="s3")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def request(method, path, body=None, **headers):
        connection = http.client.HTTPConnection(*server.server_address, timeout=60)
        connection.request(method, path, body, headers)
        answer = connection.getresponse()
        data = answer.read()
        connection.close()
        return answer.status, dict(answer.getheaders()), json.loads(data) if data else None

    yield request
    server.shutdown()
    server.server_close()


def test_reading(ask):
    status, head, body = ask("GET", "/api/search?q=name&per=2&ext=jpg")
    assert status == 200 and body["total"] == 5 and head["X-Cache"] == "miss" and head["X-Content-Type-Options"] == "nosniff"
    assert ask("GET", f"/api/search?q=name&per=2&cursor={body['next_cursor']}&ext=jpg")[0] == 200
    assert ask("GET", "/api/search?q=name&per=2&ext=jpg", **{"If-None-Match": head["ETag"]})[0] == 304
    assert [r["title"] for r in ask("GET", "/api/albums?indexed=true")[2]["results"]] == ["First album"]
    assert ask("GET", "/api/albums/random")[2][ALBUM_KEY] == "A1" and ask("GET", "/api/stats")[2]["files"] == 5


@pytest.mark.parametrize("path", ["/api/search?per=x", "/api/search?per=0", "/api/albums?indexed=perhaps", "/api/search?cursor=%21"])
def test_bad_arguments(ask, path):
    assert ask("GET", path)[0] == 400


def test_unknown_addresses(ask):
    assert [ask(m, "/api/none")[0] for m in ("GET", "POST", "DELETE")] == [404, 404, 404]


def test_changing(ask):
    admin = {"Authorization": "Bearer s3"}
    urls = json.dumps({"urls": ["https://h/a/N1"]})
    assert ask("POST", "/api/albums", urls)[0] == 401
    assert ask("POST", "/api/albums", "[]", **admin)[0] == 400 and ask("POST", "/api/albums", "{", **admin)[0] == 400
    assert ask("POST", "/api/albums", urls, **admin)[2] == {"accepted": ["N1"]}
    assert ask("DELETE", "/api/albums/none", **admin)[0] == 404 and ask("DELETE", "/api/albums/A1", **admin)[0] == 200
    assert ask("GET", "/api/search?q=name&per=2")[2]["total"] == 0
