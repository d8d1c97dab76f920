"""Documents cut out of stacks and written as files, each whole or not at all."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources import pdf
from pagewright.workers import let_workers_import

#: (content of the stack, indices of pages, title, subject) -> content of the document
Cut = Callable[[bytes, list[int], str, str], bytes]


def write_whole(path: str, content: bytes) -> None:
    """Under another name first: nobody sees half a file, and a task that is repeated leaves the same one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "wb") as file:
        file.write(content)
    os.replace(own, path)


def cut_documents(pages: DataFrame, titles: DataFrame, sources: DataFrame, cut: Cut = pdf.select) -> DataFrame:
    """pages: folder, name, place, index, as ``plans.pages_to_write`` gives them; titles: folder, name, title, subject; sources: folder, content. (folder, name, content, sha256)."""
    indices = F.transform(F.array_sort(F.collect_list(F.struct("place", "index"))), lambda x: x["index"])
    wanted = pages.groupBy("folder", "name").agg(indices.alias("indices")).join(titles, ["folder", "name"], "left").join(sources, "folder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cut(content, own, title or "", subject or "") for own, title, subject, content in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in made])], names=["folder", "name", "content", "sha256"])

    let_workers_import(pages.sparkSession)
    return wanted.select("folder", "name", "indices", "title", "subject", "content").mapInArrow(run, "folder string, name string, content binary, sha256 string")


def write_documents(documents: DataFrame, root: str) -> DataFrame:
    """documents: folder, name, content, sha256. Writes each below root, a folder that driver and executors share; (folder, name, sha256) of what is written, for the record of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = os.path.realpath(root)
        for batch in batches:
            for folder, name, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                path = os.path.realpath(f"{top}/{folder}/{name}")
                if not path.startswith(f"{top}/"):
                    raise ValueError(f"{folder}/{name} is outside of the folder")
                write_whole(path, content)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], names=["folder", "name", "sha256"])

    let_workers_import(documents.sparkSession)
    return documents.select("folder", "name", "content", "sha256").mapInArrow(run, "folder string, name string, sha256 string")
