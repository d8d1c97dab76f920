"""A ledger by key that is changed in place: a versioned Parquet table with upserts, of which readers see all or nothing.

Rows are dealt out to a fixed number of buckets by the key's hash. A change reads the buckets that it touches, writes them anew (copy on write) beside what is there, and then becomes visible by one
step: a manifest of the next version, which only one writer can create. A crash before that step leaves the version before; a second writer is refused and starts again from the new version.
Work grows with the buckets touched, and a bucket with the table by the number of buckets, so choose that number by the size that one task should write.

Layout, in a folder of any file system with an atomic rename (object stores have none):

* ``versions/NNNNNNNNNN.json``: schema, number of buckets, the folder of each bucket's rows, and the last batch of each stream;
* ``data/<version>-<token>/bucket=<b>/*.parquet``.

Defined results: a null key is no key, and its rows are refused. Of several changes of one key in one call the one with the greatest ``order`` counts, and of equals the greatest row. An empty change makes no version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.shared import Files

_BUCKET = "__bucket"


class LedgerConflictError(RuntimeError):
    """Another writer made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    key: str
    buckets: int
    folders: Mapping[int, str]
    batches: Mapping[str, int]

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "key": self.key, "buckets": self.buckets, "folders": {str(b): f for b, f in self.folders.items()}, "batches": dict(self.batches)})


class Ledger:
    """The table in a folder. ``create`` makes an empty one, unless there is one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: StructType | str, key: str, buckets: int = 64) -> Ledger:
        own = cls(spark, folder)
        shape = spark.createDataFrame([], schema).schema
        own.files.write_first(own._manifest(0), Version(0, shape, key, buckets, {}, {}).text())
        return own

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/versions/{number:010d}.json"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.folder}/versions") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        """A version's manifest, the last one's by default."""
        last = self.versions()[-1] if number is None else number
        known = json.loads(self.files.read(self._manifest(last)))
        return Version(last, StructType.fromJson(known["schema"]), known["key"], known["buckets"], {int(b): f for b, f in known["folders"].items()}, known["batches"])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, as they stay whatever is written later."""
        return self._rows(self.version(number))

    def _rows(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.folder}/{version.folders[b]}" for b in sorted(version.folders if buckets is None else set(buckets) & set(version.folders))]
        return self.spark.read.schema(version.schema).parquet(*folders) if folders else self.spark.createDataFrame([], version.schema)

    def upsert(self, rows: DataFrame, order: str | None = None, assign: Mapping[str, Column] | None = None, insert: bool = True, delete: Column | None = None, stream: str | None = None, batch: int | None = None, base: Version | None = None) -> Version:
        """Rows by key: new keys are inserted (unless insert is false), known ones updated.

        ``assign`` says what a known key's columns become, by name, from ``old.*`` and ``new.*``; by default all columns of ``rows`` replace the old ones. ``delete``, of the same, takes rows away.
        ``stream`` and ``batch`` make a call of ``foreachBatch`` count once: a batch that is not beyond the stream's last one changes nothing. ``base`` is the version that the caller looked at:
        if it isn't the last any more, the change is refused, as it is if another writer comes first."""
        known = self.version()
        if base is not None and base.number != known.number:
            raise LedgerConflictError(f"version {base.number} is not the last")
        if stream is not None and batch is not None and batch <= known.batches.get(stream, -1):
            return known
        key = known.key
        bucket = F.pmod(F.xxhash64(F.col(key).cast(known.schema[key].dataType)), F.lit(known.buckets)).cast("int")
        placed = rows.withColumn(_BUCKET, F.when(F.col(key).isNotNull(), bucket).otherwise(F.raise_error(F.lit("a ledger's key is null")).cast("int")))
        fresh = self._one_per_key(placed, key, order)
        touched = sorted(r[0] for r in fresh.select(_BUCKET).distinct().collect())  # at most the number of buckets
        if not touched:
            return known
        merged = self._merged(self._rows(known, touched).withColumn(_BUCKET, bucket), fresh, known, assign or {}, insert, delete)
        place = f"data/{known.number + 1:010d}-{uuid.uuid4().hex}"
        merged.repartition(len(touched), _BUCKET).sortWithinPartitions(_BUCKET, key).withColumnRenamed(_BUCKET, "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{place}")
        made = {int(n.removeprefix("bucket=")): f"{place}/{n}" for n in self.files.names(f"{self.folder}/{place}") if n.startswith("bucket=")}
        folders = {b: f for b, f in known.folders.items() if b not in touched} | made
        batches = dict(known.batches) | ({stream: batch} if stream is not None and batch is not None else {})
        following = Version(known.number + 1, known.schema, key, known.buckets, folders, batches)
        if not self.files.write_first(self._manifest(following.number), following.text()):
            self.files.remove(f"{self.folder}/{place}")
            raise LedgerConflictError(f"another writer made version {following.number}")
        return following

    @staticmethod
    def _one_per_key(rows: DataFrame, key: str, order: str | None) -> DataFrame:
        """With partial aggregation, so that a key with many changes is no task's burden."""
        others = [c for c in rows.columns if c != key]
        best = F.max(F.struct(*([F.col(order).alias("__order")] if order else []), *(F.col(c) for c in others)))
        return rows.groupBy(key).agg(best.alias("__best")).select(key, *(F.col(f"__best.{c}").alias(c) for c in others))

    @staticmethod
    def _merged(old: DataFrame, new: DataFrame, known: Version, assign: Mapping[str, Column], insert: bool, delete: Column | None) -> DataFrame:
        key = known.key
        a = old.select(F.struct(*old.columns).alias("old"))
        b = new.select(F.struct(*new.columns).alias("new"))
        met = a.join(b, F.col(f"old.{key}") == F.col(f"new.{key}"), "full" if insert else "left")
        if delete is not None:
            met = met.where(~F.coalesce(F.col("new").isNotNull() & delete, F.lit(False)))
        given = set(new.columns)

        def value(c: str) -> Column:
            kind = known.schema[c].dataType
            changed = assign[c] if c in assign else F.col(f"new.{c}") if c in given and not assign else F.col(f"old.{c}")
            inserted = F.col(f"new.{c}") if c in given else F.lit(None)
            return F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), inserted.cast(kind)).otherwise(changed.cast(kind)).alias(c)

        rest = [value(c) for c in known.schema.names if c != key]
        return met.select(F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}").cast(known.schema[key].dataType)).alias(key), *rest, F.coalesce(F.col(f"old.{_BUCKET}"), F.col(f"new.{_BUCKET}")).alias(_BUCKET)).select(*known.schema.names, _BUCKET)

    def with_retries(self, change: Callable[[Ledger], Version], attempts: int = 5) -> Version:
        """A change made again from the new version where another writer came first."""
        for attempt in range(attempts):
            try:
                return change(self)
            except LedgerConflictError:
                if attempt == attempts - 1:
                    raise
        raise AssertionError("unreachable")

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0, now: Callable[[], float] = time.time) -> list[str]:
        """Removes versions but the last ``keep``, and data that no version left names, if it is old enough not to be a running writer's. Returns the folders that went."""
        numbers = self.versions()
        for number in numbers[:-keep]:
            self.files.remove(self._manifest(number))
        used = {"/".join(f.split("/")[:2]) for n in numbers[-keep:] for f in self.version(n).folders.values()}
        gone = [f"data/{n}" for n in self.files.names(f"{self.folder}/data") if f"data/{n}" not in used and now() - self.files.modified(f"{self.folder}/data/{n}") >= older_than]
        for folder in gone:
            self.files.remove(f"{self.folder}/{folder}")
        return gone


UPLOADS = "sha string, document long, file string, pending boolean"


def uploaded(ledger: Ledger, files: DataFrame, **options) -> Version:
    """files: sha, document, file. Uploads that have been made: entries that wait for their file to be archived. An entry that is there stays as it is."""
    return ledger.upsert(files.select("sha", "document", "file", F.lit(True).alias("pending")), assign={"pending": F.col("old.pending")}, **options)


def archived(ledger: Ledger, files: DataFrame, **options) -> Version:
    """files: sha. Their originals are in the archive: from now on an equal file is a duplicate."""
    return ledger.upsert(files.select("sha"), assign={"pending": F.lit(False)}, insert=False, **options)
