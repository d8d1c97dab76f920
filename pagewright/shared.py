"""The folder that driver and executors share, and its files as the driver sees them (any file system that Hadoop knows)."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode only."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    Files(spark, path).remove_at_exit(path)
    return path


def cut(frame: DataFrame, name: str = "cut", made: list[str] | None = None) -> DataFrame:
    """The frame as a table in the shared folder: made once however often it is read, and whole when executors are lost. Its path is added to ``made``, for ``remove``."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    if made is not None:
        made.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove(spark: SparkSession, made: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    while made:
        Files(spark, path := made.pop()).remove(path)


def mounted(path: str) -> str:
    """A path as the file system of the machine has it; other schemes can't be opened there."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} has to be a mounted folder")
    return unquote(parts.path) if parts.scheme else path


class Files:
    """Small files of the driver's: lists of what is there, texts, and texts of which only one writer's can be."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._uri, self._conf = spark._jvm.java.net.URI, spark._jsc.hadoopConfiguration()
        self.system = self._hadoop.Path(root).getFileSystem(self._conf)
        self.local = self.system.getScheme() == "file"

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, none if it isn't there."""
        place = self._path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(place)) if self.system.exists(place) else []

    def modified(self, path: str) -> float:
        """Seconds since 1970."""
        return self.system.getFileStatus(self._path(path)).getModificationTime() / 1000

    def exists(self, path: str) -> bool:
        return self.system.exists(self._path(path))

    def read(self, path: str) -> str:
        source = self.system.open(self._path(path))
        try:
            return self._io.toString(source, "UTF-8")
        finally:
            source.close()

    def write(self, path: str, text: str) -> None:
        out = self.system.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write_first(self, path: str, text: str) -> bool:
        """Writes a file whole, unless there is one: of several writers one succeeds. Takes a file system whose rename (a link, where it is mounted) is atomic; object stores' isn't."""
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        self.write(own, text)
        try:
            if self.local:
                here, there = mounted(self._path(own).toUri().getPath()), mounted(self._path(path).toUri().getPath())
                try:
                    os.link(here, there)
                except FileExistsError:
                    return False
                return True
            self.system.rename(self._path(own), self._path(path))  # false or an error where the target is there
            return not self.system.exists(self._path(own)) and self.read(path) == text
        finally:
            self.remove(own)

    def remove(self, path: str) -> None:
        self.system.delete(self._path(path), True)

    def remove_at_exit(self, path: str) -> None:
        self.system.deleteOnExit(self._path(path))
