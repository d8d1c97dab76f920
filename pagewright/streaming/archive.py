"""An inbox as a file stream that cleans up: each file is read once, and then moved once, to where its outcome sends it.

Done files are archived by the source itself (``cleanSource``), below the archive folder under the path that they had, once the batch after theirs begins. What has failed, or is a duplicate, is moved by the step
that finds it out, to folders of their own under free names; the source then finds nothing left to archive. A step that is repeated after a restart finds a file gone from the inbox and leaves it at that.
Files and folders whose names begin with a dot or an underscore aren't seen, as everywhere in Spark. A path counts once: a file source doesn't look at one again for a week (its ``maxFileAge``). Where the same names
come again, ``watch.poll`` is the one to take. Folders are mounted ones."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagewright.shared import mounted
from pagewright.workers import let_workers_import

#: path, modificationTime, length, content -> with outcome: "done", "failed" or "duplicate"
Outcome = Callable[[DataFrame], DataFrame]


def inbox(spark: SparkSession, folder: str, archive: str, pattern: str = "*.pdf", files_per_batch: int | None = None) -> DataFrame:
    """A stream of a folder's files, sub-folders included, with their contents; what it has read goes to archive."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def move_free(path: str, target: str) -> str | None:
    """Moves a file into a folder under the first free name; none if it isn't there. A link that fails where there is a file makes a name one mover's; the same file linked before a crash is taken for moved."""
    stem, suffix = os.path.splitext(os.path.basename(path))
    os.makedirs(target, exist_ok=True)
    number = 1
    while True:
        place = f"{target}/{stem}{f' ({number})' if number > 1 else ''}{suffix}"
        try:
            os.link(path, place)
        except FileNotFoundError:
            return None
        except FileExistsError:
            try:
                if not os.path.samefile(path, place):
                    number += 1
                    continue
            except FileNotFoundError:
                return None
        os.unlink(path)
        return place


def router(folder: str, failed: str, duplicates: str, outcome: Outcome, record: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: finds out each file's outcome, hands (path, outcome) to record, and moves what isn't done, by tasks, into the folder of its kind and the sub-folder that it was in."""
    root, targets = os.path.realpath(mounted(folder)), {"failed": mounted(failed), "duplicate": mounted(duplicates)}

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for path, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = os.path.realpath(mounted(path))
                inside = os.path.relpath(os.path.dirname(own), root)
                places.append(move_free(own, os.path.normpath(f"{targets[kind]}/{inside}")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.string())], names=["path", "place"])

    def step(batch: DataFrame, number: int) -> None:
        let_workers_import(batch.sparkSession)
        known = outcome(batch).select("path", "outcome").persist()
        try:
            if record:
                record(known, number)
            known.where(F.col("outcome") != "done").mapInArrow(move, "path string, place string").write.format("noop").mode("overwrite").save()
        finally:
            known.unpersist()

    return step


def watched(files: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """The stream with its step, to be started with a trigger of the caller's. Files that a step has moved, and a batch that is repeated names again, are no error."""
    files.sparkSession.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
