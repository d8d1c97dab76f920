"""Folders, JSON lines, job folders and checksum lists as DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of all files below a folder; contents aren't read. Spark's lister leaves out names that begin with "." or "_"."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def full_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every name, listed by the driver: for inboxes, whose number of files is small."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, files = [], path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    rows = spark.createDataFrame(found, "path string, length long, millis long")
    return rows.select("path", "length", F.timestamp_millis("millis").alias("modificationTime"))


def relative(path: Column, root: str) -> Column:
    """What follows the root folder in a path."""
    plain = root.removeprefix("file:").rstrip("/")
    plain = "/" + plain.lstrip("/")
    return F.regexp_replace(path, "^.*?" + "".join(f"\\{c}" if not c.isalnum() else c for c in plain) + "/", "")


def pdf_candidates(files: DataFrame, root: str, exclude: str | None = None) -> DataFrame:
    """PDF files, none of whose folders or names begins with a dot; without those below ``exclude``. In the order of paths."""
    own = relative(F.col("path"), root)
    keep = F.lower(F.col("path")).endswith(".pdf") & ~F.exists(F.split(own, "/"), lambda x: F.startswith(x, F.lit(".")))
    if exclude:
        keep &= ~F.startswith(own, F.lit(exclude.strip("/") + "/"))
    return files.filter(keep).withColumn("name", own).orderBy("path")


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """A batch job's answers: custom_id and body (JSON text) of lines that are answers with status 200 and an object as body."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    fields = [F.get_json_object("value", p) for p in ("$.custom_id", "$.response.status_code", "$.response.body")]
    return lines.select(fields[0].alias("custom_id"), fields[1].alias("status"), fields[2].alias("body")).filter("custom_id is not null and status = '200'").filter(F.startswith("body", F.lit("{"))).select("custom_id", "body")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Every job.json one folder down, oldest first; what can't be read is left out."""
    schema = "id string, owner string, status string, filename string, kind string, callback_url string, created_at string, started_at string, finished_at string, pages int, error string, _bad string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*/job.json")
    return rows.filter("_bad is null and id is not null").drop("_bad").orderBy("created_at", "id")


def count_candidates(files: DataFrame, root: str, exclude: str | None = None) -> DataFrame:
    """How many PDF files wait below root, as one row; 0 for a folder that isn't there, whose listing is empty."""
    return pdf_candidates(files, root, exclude).agg(F.count("*").alias("n"))


def leftovers(files: DataFrame, known: DataFrame, root: str, older_than: Column) -> DataFrame:
    """What a crash left half made right below root, if nothing in it is newer: uploads (".upload-" and what follows), and folders that no known job (id) owns."""
    parts = F.split(relative(F.col("path"), root), "/")
    own = files.select(F.get(parts, 0).alias("id"), (F.size(parts) > 1).alias("inside"), "modificationTime").groupBy("id").agg(F.max("modificationTime").alias("newest"), F.bool_or("inside").alias("folder"))
    half = own.filter("newest IS NOT NULL").filter(F.col("newest") < older_than).filter(F.startswith("id", F.lit(".upload-")) | F.col("folder"))
    return half.join(known.select("id").filter(~F.startswith("id", F.lit(".upload-"))), "id", "left_anti").select("id", "newest")


class Tokens:
    """A token file on the driver, read again when its size or time changes; while it can't be read, the last good list stands."""

    def __init__(self, path: str) -> None:
        self.path, self.seen, self.known, self.broken = Path(path), None, [], False

    def rows(self) -> list[tuple[str, str]]:
        """(name, sha256) of each token."""
        try:
            state = self.path.stat()
        except FileNotFoundError:
            self.seen, self.known, self.broken = None, [], False
            return []
        if (now := (state.st_mtime_ns, state.st_size)) != self.seen:
            self.seen = now
            try:
                self.known, self.broken = [(str(t["name"]), str(t["sha256"])) for t in json.loads(self.path.read_text()).get("tokens", [])], False
            except (OSError, ValueError, KeyError, TypeError, AttributeError):
                self.broken = True
        if self.broken and not self.known:
            raise ValueError(f"{self.path.name} can't be read")
        return self.known

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "name string, sha256 string")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """code, sha256 of a checksum list; blank lines and comments are skipped."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(F.get(parts, 1).alias("code"), F.get(parts, 0).alias("sha256"))
