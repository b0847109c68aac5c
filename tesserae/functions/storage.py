"""Where jobs keep tables between steps, and how a version of a store becomes current: folders that every executor shares."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the cluster names none and the session runs on one machine (as
    in tests) a local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name in this application's folder of the shared folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/tesserae-{spark.sparkContext.applicationId}"
    fs, at = _located(spark, folder)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and it survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Conflict(RuntimeError):
    """Another writer was first."""


class Pointers:
    """Numbered pointer files in a folder: the highest readable one is current, and none is ever changed.

    A number is taken by creating its file without overwriting, so of two
    writers that start from the same state one fails with :class:`Conflict`.
    A writer that dies before its file is whole leaves a number that readers
    pass over, and the state stays the one before.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/_pointers"
        self._fs, self._at = _located(spark, self.root)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at)]
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _path(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number:010d}.json")

    def _content(self, number: int) -> dict[str, Any] | None:
        stream = self._fs.open(self._path(number))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict[str, Any]]:
        """(number, content) of the current pointer; (0, {}) where there is none."""
        for number in self._numbers():
            if (content := self._content(number)) is not None:
                return number, content
        return 0, {}

    def publish(self, content: dict[str, Any], base: int) -> int:
        """Makes ``content`` current if ``base`` still is; its number."""
        taken = self._numbers()
        if self.latest()[0] != base:
            raise Conflict(f"{self.root} is no longer at {base}")
        number = max([base, *taken]) + 1
        self._fs.mkdirs(self._at)
        self._create(number, json.dumps(content).encode())
        if self.latest()[0] != number:
            raise Conflict(f"{self.root} has moved on from {number}")
        return number

    def _create(self, number: int, data: bytes) -> None:
        if self._fs.getUri().getScheme() == "file":
            try:
                with open(os.open(self._path(number).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644), "wb") as f:
                    f.write(data)
            except FileExistsError as e:
                raise Conflict(str(e)) from e
            return
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(self._path(number), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(str(e)) from e
            raise
        out.write(bytearray(data))
        out.close()
