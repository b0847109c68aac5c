"""Queries of the training-data operators over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_path, shared_table
from . import byte_bpe, containers, copies, garbling, heavy_hitters, lookalikes, percentiles, subjects


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NAMED = (("files", "search_name"), ("files", "storage"), ("albums", "title"))


def _values(spark: SparkSession, sf_dir: str, fields: tuple[tuple[str, str], ...], in_ascii: bool = False) -> DataFrame:
    """source_table, record_id, field_name, value of the given text columns, those in ASCII too or not; one scan a table."""
    parts = []
    for table in dict.fromkeys(t for t, _ in fields):
        columns = [c for t, c in fields if t == table]
        rows = _table(spark, sf_dir, table)
        if not in_ascii:
            rows = rows.filter(reduce(lambda a, b: a | b, [garbling.not_ascii(c) for c in columns]))
        stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns]))
        if len(columns) == 1:
            parts.append(rows.select(F.lit(table).alias("source_table"), F.col("id").alias("record_id"), F.lit(columns[0]).alias("field_name"), F.col(columns[0]).alias("value")))
            continue
        parts.append(
            rows.select(F.lit(table).alias("source_table"), F.col("id").alias("record_id"), stacked.alias("x"))
            .select("source_table", "record_id", "x.field_name", "x.value")
        )
    return reduce(DataFrame.unionAll, parts)


def _counts(spark: SparkSession, sf_dir: str) -> garbling.PairCounts:
    return garbling.pair_counts([_table(spark, sf_dir, "files").select("search_name", "storage"), _table(spark, sf_dir, "albums").select("title")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = garbling.detect(spark, _values(spark, sf_dir, _NAMED), _counts(spark, sf_dir))
    return found.select("source_table", "record_id", "field_name")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbling.detect(spark, _values(spark, sf_dir, _NAMED), _counts(spark, sf_dir))


def p1_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field with its values and how many of them were restored whole but would be found once more (none should be)."""
    counts = _counts(spark, sf_dir)
    restored = garbling.detect(spark, _values(spark, sf_dir, _NAMED), counts).filter("recovered")
    again = garbling.detect(spark, restored.select("source_table", "record_id", "field_name", F.col("restored").alias("value")), counts)
    found = again.groupBy("source_table", "field_name").agg(F.count("*").alias("n"))
    held = _values(spark, sf_dir, _NAMED, True).groupBy("source_table", "field_name").agg(F.count("value").alias("held"))
    return held.join(found, ["source_table", "field_name"], "left").select("source_table", "field_name", "held", F.coalesce("n", F.lit(0)).alias("found_again"))


_SEARCHED = (("files", "search_name"), ("albums", "title"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookalikes.cases(spark, _values(spark, sf_dir, _SEARCHED, True), _counts(spark, sf_dir))
    return found.select("source_table", "record_id", "field_name")


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its consistent form."""
    return lookalikes.canonical(spark, _values(spark, sf_dir, _SEARCHED, True), _counts(spark, sf_dir))


def p2_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field with its values, how many have a canonical form, and how many values in ASCII were changed (none may be)."""
    forms = p2_canonical(spark, sf_dir)
    return forms.groupBy("source_table", "field_name").agg(
        F.count("canonical").alias("held"), F.count_if(~garbling.not_ascii("value") & (F.col("value") != F.col("canonical"))).alias("ascii_changed")
    )


_COUNTED = ["search_name", "extension"]
_LEAST_SHARE = 0.005


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "files")
    candidates = heavy_hitters.frequent(files, _COUNTED, _LEAST_SHARE)
    return heavy_hitters.exactly(files, _COUNTED, candidates, _LEAST_SHARE).select("field_name", "item")


def p3_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters.top(_table(spark, sf_dir, "files"), _COUNTED, 20)


def p3_intervals_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items above the share with their exact counts and whether the interval from lossy counting holds them."""
    files = _table(spark, sf_dir, "files")
    candidates = heavy_hitters.frequent(files, _COUNTED, _LEAST_SHARE)
    exact = heavy_hitters.exactly(files, _COUNTED, candidates, _LEAST_SHARE)
    # at most 1 / (share - epsilon) rows a field on both sides
    both = exact.join(candidates, ["field_name", "item"])
    return both.select("field_name", "item", "n", ((F.col("count_low") <= F.col("n")) & (F.col("n") <= F.col("count_high"))).alias("held"))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(percentiles.summary(_table(spark, sf_dir, "files"), "size", ["media", "extension"]))


def p4_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from slices by upload year, summed up on their own and then combined."""
    files = _table(spark, sf_dir, "files").withColumn("slice", F.coalesce(F.year("uploaded_at") >= 2024, F.lit(False)))
    slices = [percentiles.summary(files.filter(F.col("slice") == recent), "size", ["media", "extension"]) for recent in (True, False)]
    return percentiles.percentiles(percentiles.combine(*slices))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed rows of both tables, with the batch by arrival that each came in."""

    def keyed(name: str, arrival: str, text: str, equal: list[str], has_ending: bool) -> DataFrame:
        table = _table(spark, sf_dir, name).withColumn("recent", F.coalesce(F.year(arrival) >= 2024, F.lit(False)))
        return copies.keys(table, text, "id", equal, has_ending, name, ["recent"])

    files = keyed("files", "uploaded_at", "search_name", ["album_id", "size"], True)
    return files.unionByName(keyed("albums", "discovered_at", "title", [], False))


def _ledger(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The stored ledger after two batches by arrival: copies of one class are in both."""
    ledger = copies.Ledger(spark, shared_path(spark, "ledger"))
    for recent in (False, True):
        ledger.take(rows.filter(F.col("recent") == recent), f"recent={recent}")
    return ledger.read()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # keyed once: read by both batches and by the members
    rows = shared_table(_keyed(spark, sf_dir), "keyed")
    # the classes of more than one row are stored: they are read three times
    found = shared_table(copies.classes(_ledger(spark, rows)).filter("copies > 1"), "classes")
    return copies.members(rows, found)


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a class with its number of copies, from a ledger that took the tables in two batches by arrival."""
    return copies.records(copies.classes(_ledger(spark, shared_table(_keyed(spark, sf_dir), "keyed"))))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(_table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a digest of the text that its ids give back."""
    return byte_bpe.decode(p6_ids(spark, sf_dir), "ids", ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = shared_table(byte_bpe.count_tokens(_table(spark, sf_dir, "documents"), "text", ["doc_id"]), "items")
    return containers.pack(spark, items, _table(spark, sf_dir, "containers"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.filling(_packed(spark, sf_dir), _table(spark, sf_dir, "containers"))


def p7_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of container with the documents in it, those whose pieces do not add up, and the containers that hold too much."""
    # tokens are counted once
    items = shared_table(byte_bpe.count_tokens(_table(spark, sf_dir, "documents"), "text", ["doc_id"]), "items")
    kinds = _table(spark, sf_dir, "containers")
    packed = shared_table(containers.pack(spark, items, kinds), "packed")
    pieces = packed.filter("tokens > 0").groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("in_pieces"))
    of_docs = pieces.join(items.select("doc_id", F.col("tokens").alias("whole")), "doc_id").groupBy("container_kind").agg(
        F.count("*").alias("documents"), F.count_if(F.col("in_pieces") != F.col("whole")).alias("torn")
    )
    loads = packed.filter("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("load"))
    full = loads.join(F.broadcast(kinds), "container_kind").groupBy("container_kind").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("too_full"))
    return of_docs.join(full, "container_kind")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(spark, *[_table(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject_code")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_subjects(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_restored, p1_settled, p2_found, p2_canonical, p2_settled, p3_found, p3_intervals, p3_intervals_hold, p4_percentiles, p4_combined, p5_found, p5_records,
            p6_ids, p6_round_trip, p7_containers, p7_filling, p7_settled, p8_found, p8_composition,
        )
    }


def _p4_sql() -> str:
    """Order statistics of the cells, by sorting all rows: what the cumulative frequencies must give."""
    shift = f"greatest(length(bin(abs(size))) - {percentiles.BITS}, 0)"
    ps = ", ".join(f"({float(p)}::DOUBLE)" for p in percentiles.PERCENTILES)
    return f"""
WITH stacked AS (
  SELECT 'media' AS field_name, media AS group_value, size FROM files WHERE size IS NOT NULL
  UNION ALL SELECT 'extension', extension, size FROM files WHERE size IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY field_name, group_value ORDER BY size) AS rk,
         count(*) OVER (PARTITION BY field_name, group_value) AS n, {shift} AS sh
  FROM stacked),
ps(p) AS (VALUES {ps})
SELECT field_name, group_value, p, n,
       CASE WHEN size < 0 THEN -(((abs(size) >> sh) << sh) + (1::BIGINT << sh) - 1) ELSE (abs(size) >> sh) << sh END AS value_low,
       CASE WHEN size < 0 THEN -((abs(size) >> sh) << sh) ELSE ((abs(size) >> sh) << sh) + (1::BIGINT << sh) - 1 END AS value_high
FROM placed JOIN ps ON rk = greatest(1, ceil(p * n))"""


# Texts are told apart by ending, letters and numbers: what the operator says where no text is an anagram of another and no
# number is glued or taken apart, as in the test tables.
_P5_SQL = r"""
WITH r AS (
  SELECT 'files' AS source_table, id, concat_ws(chr(1), album_id, size) AS scope, lower(search_name) AS low, regexp_extract(lower(search_name), '\.([a-z0-9]{1,5})$', 1) AS ending
  FROM files WHERE album_id IS NOT NULL AND size IS NOT NULL AND search_name <> ''
  UNION ALL SELECT 'albums', id, '', lower(title), '' FROM albums WHERE title <> ''),
t AS (SELECT source_table, id, scope, ending, low, CASE WHEN ending <> '' THEN left(low, length(low) - length(ending) - 1) ELSE low END AS stem FROM r),
k AS (
  SELECT source_table, id, concat_ws(chr(1), scope, ending, array_to_string(list_sort(regexp_extract_all(stem, '\p{N}+')), ' '),
    CASE WHEN regexp_matches(stem, '[^\p{P}\p{Z}\p{C}\s+~|^=<>$`´¨]')
      THEN array_to_string(list_sort(string_split(regexp_replace(stem, '[\p{N}\p{P}\p{Z}\p{C}\s+~|^=<>$`´¨]+', '', 'g'), '')), '') ELSE low END) AS key
  FROM t),
f AS (SELECT source_table, id, min(id) OVER (PARTITION BY source_table, key) AS first_id, count(*) OVER (PARTITION BY source_table, key) AS copies FROM k)
"""


def oracle_sql() -> dict[str, str]:
    by_field = " UNION ALL ".join(
        f"SELECT '{c}' AS field_name, {c} AS item FROM files WHERE {c} <> '' GROUP BY {c} HAVING count(*) >= 0.005 * (SELECT count(*) FROM files)" for c in _COUNTED
    )
    of_fields = lambda fields, extra: " UNION ALL ".join(f"SELECT '{t}' AS source_table, '{c}' AS field_name, count({c}) AS held, 0::BIGINT AS {extra} FROM {t}" for t, c in fields)
    return {
        "p1_settled": of_fields(_NAMED, "found_again"), "p2_settled": of_fields(_SEARCHED, "ascii_changed"), "p3_found": by_field,
        "p3_intervals_hold": by_field.replace(" AS item", " AS item, count(*) AS n, true AS held"), "p4_percentiles": _p4_sql(), "p4_combined": _p4_sql(),
        "p5_found": f"{_P5_SQL} SELECT source_table, first_id, id AS copy_id FROM f WHERE id > first_id",
        "p5_records": f"{_P5_SQL} SELECT source_table, first_id, copies FROM f WHERE id = first_id",
        "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
        "p7_settled": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0::BIGINT AS torn, 0::BIGINT AS too_full FROM containers",
    }
