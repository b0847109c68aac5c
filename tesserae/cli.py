"""Command line over the service: init, discover, ingest, sync, queue, search, albums, add, delete, stats, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import album_id
from .operators import state
from .operators.migrate import migrate
from .server import serve
from .service import Options, Service
from .sources.schema import ALBUM_KEY
from .streaming import ingest


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae")
    p.add_argument("--root", required=True, help="catalog folder, shared by all executors")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    s = sub.add_parser("discover", help="merge landed discovery cards")
    s.add_argument("path"), s.add_argument("--checkpoint", required=True), s.add_argument("--follow", action="store_true")
    s = sub.add_parser("ingest", help="merge landed album pages")
    s.add_argument("path"), s.add_argument("--checkpoint", required=True), s.add_argument("--follow", action="store_true")
    s = sub.add_parser("sync", help="discover and ingest, once or at an interval")
    s.add_argument("cards"), s.add_argument("pages"), s.add_argument("--checkpoint", required=True)
    s.add_argument("--every-hours", type=float, default=24.0), s.add_argument("--cycles", type=int, default=1, help="0: for ever")
    s = sub.add_parser("queue")
    s.add_argument("--limit", type=int, default=200), s.add_argument("--stale-days", type=int)
    s = sub.add_parser("search")
    s.add_argument("q", nargs="?", default=""), s.add_argument("--media"), s.add_argument("--ext"), s.add_argument("--sort", default="relevance")
    s.add_argument("--page", type=int, default=1), s.add_argument("--per", type=int, default=20), s.add_argument("--cursor")
    s = sub.add_parser("albums")
    s.add_argument("q", nargs="?", default=""), s.add_argument("--page", type=int, default=1), s.add_argument("--per", type=int, default=20)
    s = sub.add_parser("add")
    s.add_argument("ids", nargs="+")
    s = sub.add_parser("delete")
    s.add_argument("id")
    sub.add_parser("stats")
    s = sub.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1"), s.add_argument("--port", type=int, default=8000)
    return p


_CARDS = f"card_id long, page_no int, `{ALBUM_KEY}` string, title string, file_count long, thumb string, seen_at timestamp, arrived_at timestamp"
_PAGES = f"`{ALBUM_KEY}` string, html string"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tesserae").getOrCreate()
    service = Service(spark, Options.from_environment(a.root, os.environ))
    service.catalog.create()
    migrate(service.catalog)
    now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    if a.command in ("discover", "ingest"):
        schema, commit = (_CARDS, ingest.commit_cards(service.catalog)) if a.command == "discover" else (_PAGES, ingest.commit_pages(service.catalog))
        ingest.follow(ingest.landed(spark, a.path, schema), commit, a.checkpoint, once=not a.follow).awaitTermination()
    elif a.command == "sync":
        read = lambda path, schema: ingest.landed(spark, path, schema)
        cycle = lambda: print(ingest.sync(service.catalog, read(a.cards, _CARDS), read(a.pages, _PAGES), a.checkpoint))
        ingest.sync_every(cycle, a.every_hours, a.cycles or None)
    elif a.command == "albums":
        status, _, body = service.albums(a.q, a.page, a.per)
        if status >= 400:
            print(body.decode())
            return 1
        for r in json.loads(body)["results"]:
            print(f"{r[ALBUM_KEY]:<16} {r['real_files']:>6} of {r['file_count'] or 0:<6} {'' if r['indexed'] else 'pending':<8} {r['title']}")
    elif a.command == "queue":
        for r in state.pending(service.catalog.read("albums"), now, a.limit, a.stale_days).collect():
            print(f"{r[ALBUM_KEY]:<16} {r['attempts']:>2}  {r['title']}")
    elif a.command == "add":
        ids = spark.createDataFrame([(i,) for i in a.ids], "raw string").select(album_id("raw").alias("id")).filter(F.col("id").isNotNull()).collect()
        service.enqueue([r["id"] for r in ids], now)
        print(f"{len(ids)} enqueued")
    elif a.command == "stats":
        for k, v in json.loads(service.stats()[2]).items():
            print(f"{k:<20} {v}")
    elif a.command == "serve":
        serve(service, a.host, a.port).serve_forever()
    elif a.command != "init":
        status, _, body = {
            "search": lambda: service.search(a.q, a.media, a.ext, a.sort, a.page, a.per, a.cursor),
            "delete": lambda: service.delete(a.id),
        }[a.command]()
        print(body.decode())
        return int(status >= 400)
    return 0


if __name__ == "__main__":
    sys.exit(main())
