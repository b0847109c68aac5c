"""Saved pages as sources: album pages with a script array of files, and listing pages with album cards.

The two parsers are the only places where Python sees rows; both work on Arrow
batches of whole pages and return nested rows that the JVM explodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import file_extension
from .schema import ALBUM_KEY

# Names in the pages' markup.
FILES_VARIABLE = "window.albumFiles"
OG_TITLE, OG_IMAGE = "og:title", "og:image"
THUMB_CLASS = "thumb-img"
CARD_PREFIX, CARD_SUFFIX = "View album", "→ Open"


class _Reader(HTMLParser):
    """Text of a document with its tags as gaps; what a tag means is left to the kinds of page."""

    RCDATA_CONTENT_ELEMENTS = ()  # tags inside a title are tags

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] | None = None  # pieces, while something is being read

    @classmethod
    def of(cls, page: str):
        reader = cls()
        reader.feed(page)
        reader.close()
        return reader

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def taken(self) -> str:
        words, self.text = "".join(self.text or []), None
        return words


class _Head(_Reader):
    """The first og:title, og:image and title of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.properties: dict[str, str] = {}
        self.title: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            named = dict(attrs)
            self.properties.setdefault(named.get("property") or "", (named.get("content") or "").strip())
        elif tag == "title" and self.title is None:
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.text is not None:
            self.title = self.taken()


class _Cards(_Reader):
    """The anchors to albums of a listing page; an anchor ends where it is closed or the next one begins."""

    def __init__(self) -> None:
        super().__init__()
        self.cards: dict[str, dict] = {}
        self.card: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag == "a":
            self._end()
            address = named.get("href") or ""
            path, _, key = address.rpartition("/")
            if path.endswith("/a") and key.isascii() and key.isalnum():
                self.card, self.text = {"url": address, "key": key, "image": None}, []
        elif self.card is not None:
            self.text.append(" ")
            if tag == "img" and self.card["image"] is None and THUMB_CLASS in (named.get("class") or ""):
                self.card["image"] = {k: (named.get(k) or "").strip() for k in ("src", "alt")}

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end()
        elif self.card is not None:
            self.text.append(" ")

    def _end(self) -> None:
        if self.card is None:
            return
        card, words, self.card = self.card, self.taken().split(), None
        image = card["image"] or {"src": "", "alt": ""}
        rest, counts = _without_counts(words)
        self.cards.setdefault(card["key"], {
            "url": card["url"], ALBUM_KEY: card["key"], "title": image["alt"] or _card_title(rest), "thumb": image["src"], "file_count": counts[-1] if counts else 0,
        })


def _without_counts(words: list[str]) -> tuple[list[str], list[int]]:
    """Words without each "N files", and the numbers N."""
    rest: list[str] = []
    counts: list[int] = []
    for word in words:
        unit = re.match("files?", word, re.IGNORECASE)
        if unit and not word[unit.end() : unit.end() + 1].isalnum() and rest and (number := re.search("[0-9]+$", rest[-1])):
            counts.append(int(number[0]))
            before = rest.pop()[: number.start()]
            rest += [x for x in (before, word[unit.end() :]) if x]
        else:
            rest.append(word)
    return rest, counts


def _card_title(words: list[str]) -> str:
    return " ".join(words).removeprefix(CARD_PREFIX).strip().removesuffix(CARD_SUFFIX).strip(" -")


# A scalar after a key, a string on its own, the quote of a string that never ends, and brackets.
_STRING = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
_TOKEN = re.compile(rf"(?:(?P<key>[A-Za-z_$][\w$]*|{_STRING})\s*:\s*(?P<value>{_STRING}|[\w.+-]+)?)|(?P<text>{_STRING})|(?P<cut>[\"'])|(?P<open>[\[{{])|(?P<close>[\]}}])", re.S)
_ESCAPED = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.S)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def script_text(literal: str) -> str:
    """The text of a script string without its quotes."""
    if "\\" not in literal:
        return literal
    text = _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROL.get(m[3], m[3]), literal)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _scalar(token: str) -> str:
    return script_text(token[1:-1]) if token[0] in "\"'" else token


def array_objects(source: str, start: int) -> tuple[list[dict[str, str]], bool] | None:
    """(the objects of the array literal that begins at ``start``, by their scalar fields; whether any has an id); None if the array never closes.

    What is nested deeper than the objects' own fields is passed over.
    """
    objects: list[dict[str, str]] = []
    depth, any_id = 0, False
    for token in _TOKEN.finditer(source, start):
        kind = token.lastgroup
        if kind in ("key", "value"):
            name = _scalar(token["key"])
            any_id = any_id or name == "id"
            if depth == 2 and token["value"] is not None:
                objects[-1][name] = _scalar(token["value"]).strip()
        elif kind == "open":
            depth += 1
            if depth == 2:
                objects.append({})
        elif kind == "close":
            depth -= 1
            if depth == 0:
                return objects, any_id
        elif kind == "cut":
            return None
    return None


_TIME = re.compile(r"(\d{1,2}):(\d{1,2}):(\d{1,2}) +(\d{1,2})/(\d{1,2})/(\d{4})", re.ASCII)


def _time(text: str) -> str | None:
    if not (m := _TIME.fullmatch(text.strip())):
        return None
    hour, minute, second, day, month, year = map(int, m.groups())
    try:
        return datetime(year, month, day, hour, minute, second).isoformat()
    except ValueError:
        return None


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() else None


def _file(fields: dict[str, str]) -> dict:
    get = lambda name: fields.get(name, "")
    return {
        "file_id": _number(get("id")), "storage": get("name"), "original": get("original"), "slug": get("slug"), "mime": get("type"), "media": get("extension"),
        "size": _number(get("size")) or 0, "uploaded_at": _time(get("timestamp")), "search_name": get("original") or get("slug") or get("name"),
    }


def parse_album(page: str) -> dict:
    """title, thumb, files, blob (a complete file array was there) and parse_error of an album page."""
    head = _Head.of(page)
    # a page's own title names the site after a bar
    title = head.properties.get(OG_TITLE) or (head.title or "").partition("|")[0].strip()
    out = {"title": title, "thumb": head.properties.get(OG_IMAGE, ""), "files": [], "blob": False, "parse_error": False}
    begin = re.search(re.escape(FILES_VARIABLE) + r"\s*=\s*(?=\[)", page)
    if begin is None:
        return out
    read = array_objects(page, begin.end())
    if read is None:
        return out | {"parse_error": True}
    objects, any_id = read
    files = [f for f in map(_file, objects) if f["file_id"] is not None]
    return out | {"files": files, "blob": True, "parse_error": any_id and not files}


def parse_listing(page: str) -> list[dict]:
    """The album cards of a listing page, each album once, in order."""
    reader = _Cards.of(page)
    reader._end()
    return list(reader.cards.values())


_FILE = "struct<file_id:long,storage:string,original:string,slug:string,mime:string,media:string,size:long,uploaded_at:string,search_name:string>"
_ALBUM = f"title string, thumb string, files array<{_FILE}>, blob boolean, parse_error boolean"
_CARDS = f"array<struct<url:string,{ALBUM_KEY}:string,title:string,thumb:string,file_count:long>>"
_FILE_TYPE = pa.struct([
    ("file_id", pa.int64()), ("storage", pa.string()), ("original", pa.string()), ("slug", pa.string()), ("mime", pa.string()), ("media", pa.string()),
    ("size", pa.int64()), ("uploaded_at", pa.string()), ("search_name", pa.string()),
])
_CARD_TYPE = pa.struct([("url", pa.string()), (ALBUM_KEY, pa.string()), ("title", pa.string()), ("thumb", pa.string()), ("file_count", pa.int64())])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, one a file: path and html."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def album_pages(pages: DataFrame, key: str = ALBUM_KEY) -> DataFrame:
    """Pages (key, html) parsed: key, title, thumb, files, blob, parse_error.  A null page is one without files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse_album(p or "") for p in batch.column(1).to_pylist()]
            column = lambda name, kind: pa.array([p[name] for p in parsed], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column("title", pa.string()), column("thumb", pa.string()), column("files", pa.list_(_FILE_TYPE)), column("blob", pa.bool_()), column("parse_error", pa.bool_())],
                names=[key, "title", "thumb", "files", "blob", "parse_error"],
            )

    return pages.select(key, "html").mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {_ALBUM}")


def album_files(parsed: DataFrame, key: str = ALBUM_KEY) -> DataFrame:
    """The files of parsed pages as rows: album_id, pos and the columns of files."""
    rows = parsed.filter("blob AND NOT parse_error").select(F.col(key).alias("album_id"), F.posexplode("files").alias("pos", "f"))
    return rows.select(
        "album_id", "pos", "f.file_id", "f.search_name", "f.storage", "f.slug", "f.mime", "f.media", file_extension(F.col("f.search_name")).alias("extension"),
        "f.size", F.col("f.uploaded_at").cast("timestamp_ntz").alias("uploaded_at"),
    )


def listing_cards(pages: DataFrame) -> DataFrame:
    """Listing pages (page_no, html) as rows: page_no, pos, url, key, title, thumb, file_count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_listing(p or "") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_CARD_TYPE))], names=["page_no", "cards"])

    listed = pages.select(F.col("page_no").cast("long").alias("page_no"), "html").mapInArrow(run, f"page_no long, cards {_CARDS}")
    return listed.select("page_no", F.posexplode("cards").alias("pos", "c")).select("page_no", "pos", "c.*")


def album_page_of(files: DataFrame, per_page: int = 200) -> DataFrame:
    """The reverse of the parser, for round trips: pages (page_key, html) of at most ``per_page`` files of an album each."""
    js = lambda c: F.expr(f"substring(to_json(named_struct('v', coalesce({c}, ''))), 6, length(to_json(named_struct('v', coalesce({c}, '')))) - 6)")
    item = F.concat(
        F.lit("{\n  id: "), F.col("file_id").cast("string"), F.lit(",\n  name: "), js("storage"), F.lit(",\n  original: "), js("search_name"), F.lit(",\n  slug: "), js("slug"),
        F.lit(",\n  type: "), js("mime"), F.lit(",\n  extension: "), js("media"), F.lit(",\n  size: "), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("string"),
        F.lit(',\n  timestamp: "'), F.coalesce(F.date_format("uploaded_at", "HH:mm:ss dd/MM/yyyy"), F.lit("")), F.lit('"\n}'),
    )
    chunk = F.floor(F.col("id") / per_page).cast("string")
    return files.select(F.concat_ws("/", "album_id", chunk).alias("page_key"), "id", item.alias("item")).groupBy("page_key").agg(
        F.concat(F.lit("<title>x | y</title><script>window.albumFiles = ["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), ", "), F.lit("];</script>")).alias("html")
    )
