"""Scalar functions of the catalog as built-in column expressions (all stay in generated JVM code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(column: str | Column) -> Column:
    """ASCII-only case folding: what LIKE and NOCASE compare by.

    ``translate`` looks every character up in a map; texts that are all ASCII
    take the byte loop of ``lower`` instead, which folds them in the same way.
    """
    column = column if isinstance(column, Column) else F.col(column)
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def file_extension(name: str | Column) -> Column:
    """The ending after the last dot of the last path piece, if it is 1 to 16 ASCII letters or digits; else ''."""
    piece = F.regexp_extract(F.replace(F.coalesce(name if isinstance(name, Column) else F.col(name), F.lit("")), F.lit("\\"), F.lit("/")), r"(?s)([^/]*)\z", 1)
    return F.lower(F.regexp_extract(piece, r"(?s)\A.*\.([A-Za-z0-9]{1,16})\z", 1))


def album_id(raw: str | Column) -> Column:
    """The id in an album address (`/a/<id>`) or a bare id; null for anything else."""
    text = raw if isinstance(raw, Column) else F.col(raw)
    linked, bare = F.regexp_extract(text, "/a/([A-Za-z0-9]+)", 1), F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    return F.when(linked != "", linked).when(bare.rlike(r"\A[A-Za-z0-9]+\z"), bare)


def parse_timestamp(text: str | Column) -> Column:
    """`HH:MM:SS DD/MM/YYYY` (single digits allowed) as a zone-less timestamp; null if it is none."""
    text = text if isinstance(text, Column) else F.col(text)
    return F.try_to_timestamp(F.trim(text), F.lit("H:m:s d/M/yyyy")).cast("timestamp_ntz")


def first_filled(*names: str | Column) -> Column:
    """The first of several texts that is neither null nor blank, trimmed; else ''."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names], F.lit(""))


def format_size(size: str | Column) -> Column:
    """B, KB, MB or GB by 1024; no decimals for bytes or from 10 on, else one; '' for none."""
    n = (size if isinstance(size, Column) else F.col(size)).cast("double")
    units = ["B", "KB", "MB", "GB"]
    out = F.lit("")
    for i in reversed(range(4)):
        value = n / F.lit(float(1024**i))
        whole = F.concat(F.round(value, 0).cast("long").cast("string"), F.lit(f" {units[i]}"))
        tenth = F.concat(F.round(value, 1).cast("decimal(12,1)").cast("string"), F.lit(f" {units[i]}"))
        shown = whole if i == 0 else F.when(value >= 10, whole).otherwise(tenth)
        fits = F.lit(True) if i == 3 else n < float(1024 ** (i + 1))
        out = shown if i == 3 else F.when(fits, shown).otherwise(out)
    return F.when(n.isNull() | (n == 0), F.lit("")).otherwise(out)


def format_date(ts: str | Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(""))


def format_time(ts: str | Column) -> Column:
    """A time for reading, as `Jan 31, 2024, 1:02 PM`; '-' for none."""
    return F.coalesce(F.date_format(ts, "MMM d, yyyy, h:mm a"), F.lit("-"))


def album_url(key: str | Column, site: str) -> Column:
    """The address of an album on a site."""
    return F.concat(F.lit(site.rstrip("/") + "/a/"), key if isinstance(key, Column) else F.col(key))


def first_letter(text: str | Column) -> Column:
    """The first character in upper case, '?' for none."""
    letter = F.upper(F.substring(F.trim(text), 1, 1))
    return F.when(letter == "", "?").otherwise(F.coalesce(letter, F.lit("?")))


def etag(body: str | Column) -> Column:
    return F.concat(F.lit('"'), F.sha1(body), F.lit('"'))


def base64url(text: str | Column) -> Column:
    return F.translate(F.base64(F.encode(text, "utf-8")), "+/=", "-_")


def trigrams(text: str | Column) -> Column:
    """All overlapping three-character pieces of the lower-case text, in order; in time proportional to its length."""
    low = F.lower(text)
    n = F.char_length(low) - 2
    characters = F.split(low, "")
    first, second, third = (F.slice(characters, i, n) for i in (1, 2, 3))
    pieces = F.zip_with(F.zip_with(first, second, lambda a, b: F.concat(a, b)), third, lambda a, b: F.concat(a, b))
    return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))


def retry_after(status: str, header: str) -> Column:
    """Seconds that a 429 or 503 answer asks to wait; null otherwise."""
    return F.when(F.col(status).isin(429, 503), F.expr(f"try_cast(trim({header}) AS double)"))
