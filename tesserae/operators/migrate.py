"""Bringing a stored catalog to the schema of this version, once, in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.schema import META, SCHEMA_VERSION, Catalog
from .merge import backfill_extension, set_meta


def version_of(meta: DataFrame) -> int:
    """The schema version that a store names; 1 where it names none."""
    found = meta.filter("key = 'schema_version'").select(meta["value"].try_cast("int")).first()
    return 1 if found is None or found[0] is None else found[0]


def migrated(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What must be written to come to ``SCHEMA_VERSION``; nothing for a store that is there.

    Columns that an older store lacks are null when they are read, so what is
    left to do is to derive them: the extensions of files (since version 2)
    and the columns themselves (by writing, since version 3).
    """
    version = version_of(tables["meta"])
    if version > SCHEMA_VERSION:
        raise RuntimeError(f"the store has schema {version}, this program {SCHEMA_VERSION}")
    if version == SCHEMA_VERSION:
        return {}
    marks = [("schema_version", str(SCHEMA_VERSION)), ("extension_backfill", "done")]
    entries = tables["meta"].sparkSession.createDataFrame(marks, META)
    return {"files": backfill_extension(tables["files"]), "albums": tables["albums"], "meta": set_meta(tables["meta"], entries)}


def migrate(catalog: Catalog) -> bool:
    """Whether the stored catalog had to be changed."""
    if version_of(catalog.read("meta")) == SCHEMA_VERSION:
        return False
    return catalog.update(migrated)
