"""What the operators of this subpackage share: the shared folder, workers' imports and memory, and frame helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.workers import let_workers_import


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, and the table's path: cuts the lineage and survives lost executors.

    Read back as a file, it also leaves behind the constraints that plans of repeated joins would pile up on the driver."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path), path


def cut(frame: DataFrame, name: str = "cut") -> DataFrame:
    return written(frame, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder when the session's JVM ends, for what a lazy result still reads."""
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def give_back() -> None:
    """At the end of a task, hands free memory of a Python worker back to the system: Spark keeps workers for later tasks, and what they held would count on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hidden(name: str) -> str:
    """A name for a helper column that an input's extra columns won't have."""
    return f"__pw_{name}"


def numbered(docs: DataFrame) -> DataFrame:
    """The columns as c0, c1 ...: no column of an input then clashes with a helper's; ``toDF(*docs.columns)`` names them back."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def number_of(docs: DataFrame, column: str) -> str:
    """A column's name in ``numbered``."""
    return f"c{[c.lower() for c in docs.columns].index(column.lower())}"
