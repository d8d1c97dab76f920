"""Documents as files of a folder, all of a job or none: a data source that is written to.

    write_committed(documents, root)          # plan, number, folder, stem, suffix, content

Tasks write contents into a hidden folder of the job and list them; nothing is visible until all have succeeded. The commit then notes that the job is decided, and moves files to their places. A crash after that note is
made good by ``recover``, which goes on where the job stopped; every job recovers the ones before it. Before that note, or if a task fails, all that is left are hidden files that ``recover`` sweeps.

A plan (a stack's) that is written again replaces what its last run wrote, but only files that still are what was written, by their hash: others may have been changed, or be another plan's by now. A document that is
to be what is there already stays in place, so a rerun changes nothing. Names are free ones: "stem", then "stem (2)", ..., where a link that fails if its target is there makes a name one writer's. A record per plan
is kept line by line, so that it names every file that was placed, whenever a job stopped.

The folder has to be mounted on the driver and all executors. The driver holds a plan's documents at a time (names and hashes, not contents), and one short message per task.

Defined results: an empty table changes nothing. A null stem is "Document", a null folder the root, a null content empty. A folder that leads outside of the root fails the job before anything is visible.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagewright.shared import mounted
from pagewright.workers import let_workers_import

_STAGING, _RECORDS, _DECIDED = ".staging", ".records", "decided.json"
#: Names whose last number is remembered within a commit; a forgotten one is counted from the start again.
_MOST_NAMES = 100_000


def _sha(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def _lines(path: str) -> Iterator[dict]:
    """JSON lines; what a crash has cut off at the end is left out."""
    with open(path, encoding="utf-8") as file:
        for line in file:
            if line.endswith("\n"):
                yield json.loads(line)


class _Record:
    """What a plan's last job has placed: a first line with the job and what was there before it, then a line per document."""

    def __init__(self, root: str, plan: str) -> None:
        self.path = f"{root}/{_RECORDS}/{quote(plan, safe='')[:120]}-{hashlib.sha256(plan.encode()).hexdigest()[:16]}.jsonl"
        self.plan, self.job, self.old, self.files, self.meant = plan, None, [], [], {}
        if os.path.exists(self.path):
            first, *rest = _lines(self.path)
            self.job, self.old = first["job"], first["old"]
            for line in rest:
                if "meant" in line:
                    self.meant[line["number"]] = line["meant"]
                else:
                    self.files.append(line)

    def begin(self, job: str) -> None:
        self.job, self.old, self.files, self.meant = job, self.files, [], {}
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        with open(own, "w", encoding="utf-8") as file:
            file.write(json.dumps({"plan": self.plan, "job": job, "old": self.old}) + "\n")
        os.replace(own, self.path)

    def add(self, line: dict) -> None:
        with open(self.path, "ab", buffering=0) as file:
            file.write(json.dumps(line).encode() + b"\n")
        if "meant" in line:
            self.meant[line["number"]] = line["meant"]
        else:
            self.files.append(line)


def _standing(root: str, plan: str) -> list[dict]:
    """What became of the files of a plan's last job, found out in a task: contents are read here and not by the driver."""
    found = []
    for known in _Record(root, plan).files:
        path = f"{root}/{known['name']}"
        try:
            at = os.stat(path)
            state = "fits" if _sha(path) == known["sha256"] else "changed"
            found.append(known | {"state": state, "size": at.st_size, "mtime": at.st_mtime_ns})
        except FileNotFoundError:
            found.append(known | {"state": "gone"})
    return found


@dataclass
class _Written(WriterCommitMessage):
    listing: str
    documents: int


class _DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.root, self.job = os.path.realpath(mounted(options["root"])), uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        staging, token, n, last = f"{self.root}/{_STAGING}/{self.job}", uuid.uuid4().hex, 0, object()
        os.makedirs(staging, exist_ok=True)
        with open(f"{staging}/{token}.jsonl", "w", encoding="utf-8") as listing:
            for row in iterator:
                folder, stem, suffix, content = row.folder or "", row.stem or "Document", row.suffix or "", bytes(row.content or b"")
                place = os.path.realpath(f"{self.root}/{folder}")
                if place != self.root and not place.startswith(f"{self.root}/") or "/" in stem + suffix or stem.startswith("."):
                    raise ValueError(f"{folder}/{stem}{suffix} is outside of the folder")
                if row.plan != last:
                    last = row.plan
                    listing.write(json.dumps({"plan": row.plan or "", "old": _standing(self.root, row.plan or "")}) + "\n")
                staged = f"{token}.{n}"
                with open(f"{staging}/{staged}", "wb") as file:
                    file.write(content)
                listing.write(json.dumps({"plan": row.plan or "", "number": row.number, "folder": os.path.relpath(place, self.root), "stem": stem, "suffix": suffix, "sha256": hashlib.sha256(content).hexdigest(), "staged": staged}) + "\n")
                n += 1
        return _Written(f"{token}.jsonl", n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        recover(self.root)
        staging = f"{self.root}/{_STAGING}/{self.job}"
        os.makedirs(staging, exist_ok=True)
        with open(f"{staging}/{_DECIDED}.tmp", "w", encoding="utf-8") as file:
            json.dump([m.listing for m in messages if m and m.documents], file)
        os.replace(f"{staging}/{_DECIDED}.tmp", f"{staging}/{_DECIDED}")
        _Forward(self.root, self.job).run()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:  # noqa: ARG002
        shutil.rmtree(f"{self.root}/{_STAGING}/{self.job}", ignore_errors=True)


class _Forward:
    """Moves what a decided job has written to its places. Each step can be done twice."""

    def __init__(self, root: str, job: str) -> None:
        self.root, self.job, self.staging = root, job, f"{root}/{_STAGING}/{job}"
        self.numbers: OrderedDict[tuple, int] = OrderedDict()

    def run(self) -> None:
        with open(f"{self.staging}/{_DECIDED}", encoding="utf-8") as file:
            listings = json.load(file)
        for listing in sorted(listings):
            for plan, lines in groupby(_lines(f"{self.staging}/{listing}"), lambda x: x["plan"]):
                first, *documents = lines
                self._plan(plan, first["old"], documents)
        shutil.rmtree(self.staging, ignore_errors=True)

    def _plan(self, plan: str, old: list[dict], documents: list[dict]) -> None:
        record = _Record(self.root, plan)
        if record.job != self.job:
            record.begin(self.job)
        standing = {}
        for known in old:
            if known["state"] == "fits" and self._as_it_was(known):
                standing.setdefault(self._wanted(known), []).append(known)
        stays = {d["number"]: standing[self._wanted(d)].pop(0) for d in documents if standing.get(self._wanted(d))}
        done = {f["number"] for f in record.files}
        taken = {f["name"] for f in record.files}  # where the job was stopped, these may be names that the last run had
        for known in (k for some in standing.values() for k in some):
            if known["name"] not in taken:
                self._unlink(f"{self.root}/{known['name']}")
                self.numbers.pop((known["folder"], known["stem"], known["suffix"]), None)
        for document in sorted(documents, key=lambda d: (d["number"] is not None, d["number"])):
            if document["number"] in done:
                continue
            entry = {k: document[k] for k in ("number", "folder", "stem", "suffix", "sha256")}
            name = stays[document["number"]]["name"] if document["number"] in stays else self._placed(record, document)
            record.add(entry | {"name": name})

    @staticmethod
    def _wanted(document: dict) -> tuple:
        return document["folder"], document["stem"], document["suffix"], document["sha256"]

    def _as_it_was(self, known: dict) -> bool:
        try:
            at = os.stat(f"{self.root}/{known['name']}")
        except FileNotFoundError:
            return False
        return (at.st_size, at.st_mtime_ns) == (known["size"], known["mtime"])

    @staticmethod
    def _unlink(path: str) -> None:
        try:
            os.unlink(path)
        except FileNotFoundError:
            pass

    def _placed(self, record: _Record, document: dict) -> str:
        """Links a document's file to the first free name."""
        staged, folder = f"{self.staging}/{document['staged']}", document["folder"]
        before = record.meant.get(document["number"])
        if before and os.path.exists(f"{self.root}/{before}") and os.path.samefile(staged, f"{self.root}/{before}"):
            return before  # linked, and stopped before that was recorded
        os.makedirs(f"{self.root}/{folder}", exist_ok=True)
        key = folder, document["stem"], document["suffix"]
        number = self.numbers.get(key, 1)
        while True:
            name = os.path.normpath(f"{folder}/{document['stem']}{f' ({number})' if number > 1 else ''}{document['suffix']}")
            if not os.path.lexists(f"{self.root}/{name}"):
                record.add({"number": document["number"], "meant": name})
                try:
                    os.link(staged, f"{self.root}/{name}")
                    break
                except FileExistsError:
                    pass
            number += 1
        self.numbers[key] = number + 1
        if len(self.numbers) > _MOST_NAMES:
            self.numbers.popitem(last=False)
        return name


def recover(root: str, older_than: float = 86_400.0, now=time.time) -> list[str]:
    """Finishes the jobs that were decided, and sweeps those that weren't and are old enough not to be running. Returns the jobs that were finished."""
    place, finished = mounted(root), []
    staging = f"{place}/{_STAGING}"
    for job in sorted(os.listdir(staging)) if os.path.isdir(staging) else []:
        if os.path.exists(f"{staging}/{job}/{_DECIDED}"):
            _Forward(place, job).run()
            finished.append(job)
        elif now() - os.path.getmtime(f"{staging}/{job}") >= older_than:
            shutil.rmtree(f"{staging}/{job}", ignore_errors=True)
    return finished


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "plan string, number long, folder string, stem string, suffix string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ARG002
        return _DocumentWriter(self.options)


def write_committed(documents: DataFrame, root: str) -> None:
    """documents: plan, number, folder, stem, suffix, content. Writes each plan's documents below root, in the order of their numbers, in place of what the plan's last run wrote."""
    spark = documents.sparkSession
    let_workers_import(spark)
    spark.dataSource.register(DocumentSink)
    rows = documents.select("plan", F.col("number").cast("long").alias("number"), "folder", "stem", "suffix", F.col("content").cast("binary").alias("content"))
    rows.repartition("plan").sortWithinPartitions("plan", "number").write.format("documents").mode("append").option("root", root).save()


def records(spark: SparkSession, root: str) -> DataFrame:
    """What each plan's last run has placed: plan, number, name, sha256."""
    lines = spark.read.schema("plan string, job string, number long, name string, sha256 string, meant string").json(f"{root}/{_RECORDS}/*.jsonl")
    file = F.input_file_name()
    plans = lines.where(F.col("plan").isNotNull()).select(file.alias("file"), "plan")
    placed = lines.where(F.col("name").isNotNull()).select(file.alias("file"), "number", "name", "sha256")
    return placed.join(plans, "file").select("plan", "number", "name", "sha256")
