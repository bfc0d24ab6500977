"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, and only in local mode, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path of a path: works for every store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files under a folder."""
    fs, p = filesystem(spark, path)
    return fs.getContentSummary(p).getLength()


def delete(spark: SparkSession, path: str, recursive: bool = True) -> bool:
    fs, p = filesystem(spark, path)
    return fs.delete(p, recursive)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is missing."""
    fs, p = filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


class Journal:
    """States of something, as numbered files in a folder: each is written whole, by whoever comes first with its number.

    A file that was cut off is known by its checksum and does not count, so a state is there or is not.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in names(self.spark, self.path) if n.endswith(".json") and n.split(".")[0].isdigit())

    def _read(self, version: int) -> dict | None:
        fs, p = filesystem(self.spark, f"{self.path}/{version:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        body, _, code = text.rpartition("\n")
        return json.loads(body) if code == str(zlib.crc32(body.encode())) else None

    def latest(self) -> tuple[int, dict | None]:
        """Number and contents of the last whole state; (number, None) if there is none."""
        found = self._versions()
        for version in reversed(found):
            state = self._read(version)
            if state is not None:
                return found[-1], state
        return (found[-1] if found else 0), None

    def commit(self, version: int, state: dict) -> int:
        """Writes the state that follows `version`; raises if another writer has done so."""
        body = json.dumps(state)
        fs, p = filesystem(self.spark, f"{self.path}/{version + 1:012d}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as error:
            raise RuntimeError(f"{p} is there already: another writer has changed it") from error
        out.write(bytearray(f"{body}\n{zlib.crc32(body.encode())}".encode()))
        out.close()
        for old in self._versions()[: -self.keep]:
            delete(self.spark, f"{self.path}/{old:012d}.json")
        return version + 1
