"""Table schemas of the catalog and the folder-of-versions store that keeps them.

Plain Parquet has no MERGE, so every write operator is a function from state to
state; a :class:`Catalog` writes the new state beside the old one and then
publishes one small numbered pointer file, so readers always see a whole
version and writers that meet start again from the newer one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.storage import Conflict, Pointers

ALBUM_KEY = "bunkr_id"  # the natural key's name in the tables

ALBUMS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField(ALBUM_KEY, T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("file_count", T.LongType()), T.StructField("thumb", T.StringType()), T.StructField("discovered_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("indexed_at", T.TimestampType()), T.StructField("attempts", T.IntegerType()),
    T.StructField("last_error", T.StringType()), T.StructField("dead", T.IntegerType()),
])
FILES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("album_id", T.StringType()), T.StructField("file_id", T.LongType()),
    T.StructField("search_name", T.StringType()), T.StructField("storage", T.StringType()), T.StructField("slug", T.StringType()),
    T.StructField("mime", T.StringType()), T.StructField("media", T.StringType()), T.StructField("extension", T.StringType()),
    T.StructField("size", T.LongType()), T.StructField("uploaded_at", T.TimestampNTZType()),
])
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
TABLES = {"albums": ALBUMS, "files": FILES, "meta": META}
SCHEMA_VERSION = 3


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order and types; missing ones are null, further ones go."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


class Catalog:
    """Versioned tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.pointers = Pointers(spark, self.root)
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def pointer(self) -> dict[str, str]:
        """Table -> version folder now current."""
        return self.pointers.latest()[1].get("tables", {})

    def create(self) -> None:
        """Empty tables and the schema version; existing tables stay as they are.

        A folder with versions but without a pointer to them is refused: it
        is a store that was damaged, not a new one.
        """
        now = self.pointer()
        missing = {t: s for t, s in TABLES.items() if t not in now}
        if not now and any(self._fs.exists(self._path(t)) for t in TABLES):
            raise RuntimeError(f"{self.root} holds table versions but no pointer to them")
        empty = {t: self.spark.createDataFrame([], s) for t, s in missing.items()}
        if "meta" in empty:
            empty["meta"] = self.spark.createDataFrame([("schema_version", str(SCHEMA_VERSION))], META)
        if empty:
            self.commit(empty)

    def _read(self, version: str, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{version}")

    def read(self, table: str) -> DataFrame:
        return self._read(self.pointer()[table], table)

    def commit(self, tables: dict[str, DataFrame], base: int | None = None, batch: tuple[str, int] | None = None) -> None:
        """Writes new versions of some tables and makes all of them current at once.

        base: the number of the state that they were made from; another state by now is a :class:`Conflict`.
        batch: the stream and the number of the batch that this state includes.
        """
        number, content = self.pointers.latest()
        if base is not None and number != base:
            raise Conflict(f"{self.root} is no longer at {base}")
        now, batches = dict(content.get("tables", {})), dict(content.get("batches", {}))
        for name, df in tables.items():
            version = f"{name}/v-{uuid.uuid4().hex}"
            conform(df, TABLES[name]).write.parquet(f"{self.root}/{version}")
            now[name] = version
        if batch is not None:
            batches[batch[0]] = batch[1]
        self.pointers.publish({"tables": now, "batches": batches}, number)

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], batch: tuple[str, int] | None = None, tries: int = 5) -> bool:
        """Commits what ``change`` makes of the current tables, starting again where another writer was first.

        A batch that the state holds already is passed over: False.
        """
        for left in reversed(range(tries)):
            number, content = self.pointers.latest()
            if batch is not None and content.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return False
            state = {t: self._read(v, t) for t, v in content["tables"].items()}
            try:
                self.commit(change(state), number, batch)
                return True
            except Conflict:
                if not left:
                    raise
        return False

    def vacuum(self) -> int:
        """Deletes table versions that are not current (no reader or writer may be at work); the number of folders gone."""
        current = set(self.pointer().values())
        gone = 0
        for table in TABLES:
            if self._fs.exists(self._path(table)):
                for status in self._fs.listStatus(self._path(table)):
                    if f"{table}/{status.getPath().getName()}" not in current:
                        gone += bool(self._fs.delete(status.getPath(), True))
        return gone

    def bytes(self) -> int:
        """Stored size of the current versions."""
        return sum(self._fs.getContentSummary(self._path(v)).getLength() for v in self.pointer().values())
