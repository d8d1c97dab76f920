"""Plans, reviews and verdicts as text; what a document sink has to write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.names import unique_names
from pagewright.functions.ranges import format_indices, parse_pages

DOCUMENT = "pages string, title string, date string, issuer string, summary string, confidence double, needs_review boolean, review_reason string"
PLAN = f"source string, source_sha256 string, page_count int, folder string, documents array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in DOCUMENT.split(', ')))}>>, dropped_pages string"


def to_plan(docs: DataFrame, key: str, order: str) -> DataFrame:
    """docs: key, order and the fields of a document. A plan's documents, in order, as JSON text; null fields are left out."""
    fields = [F.col(n).cast(t).alias(n) if n in docs.columns else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in DOCUMENT.split(", "))]
    rows = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("d")))).alias("x"))
    return rows.select(key, F.to_json(F.struct(F.transform("x", lambda r: r["d"]).alias("documents"))).alias("plan"))


def to_decisions(pages: DataFrame, key: str) -> DataFrame:
    """pages: key, index, starts_new, confidence, reason. The verdicts on a stack's pages, in order, as JSON text; pages count from 1."""
    row = F.struct((F.col("index") + 1).alias("page"), "starts_new", F.col("confidence").cast("double").alias("confidence"), "reason")
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("index").alias("o"), row.alias("d")))).alias("x"))
    return rows.select(key, F.to_json(F.transform("x", lambda r: r["d"])).alias("decisions"))


def from_plan(plans: DataFrame, key: str, json: str = "plan") -> DataFrame:
    """One row per document of each plan, with number from 1; fields that are missing get their defaults."""
    read = plans.select(key, F.from_json(json, PLAN).alias("p")).select(key, F.posexplode("p.documents").alias("n", "d"))
    d = lambda f: F.col(f"d.{f}")
    return read.select(
        key, (F.col("n") + 1).alias("number"), F.coalesce(d("pages"), F.lit("")).alias("pages"), F.coalesce(d("title"), F.lit("")).alias("title"), d("date").alias("date"), d("issuer").alias("issuer"),
        F.coalesce(d("summary"), F.lit("")).alias("summary"), F.coalesce(d("confidence"), F.lit(1.0)).alias("confidence"), F.coalesce(d("needs_review"), F.lit(False)).alias("needs_review"), F.coalesce(d("review_reason"), F.lit("")).alias("review_reason"),
    )


def keep_name_plans(pages: DataFrame, title: Column, blank: Column, drop_blank: bool = True) -> DataFrame:
    """pages: stack_id, index. One document per stack under the file's own name, with the pages that aren't blank (all, unless drop_blank): (stack_id, page_count, title, pages, dropped_pages, problem).

    Pages are ranges from 1; a stack without content has a problem and no pages. A stack's page numbers are one row's array, as its plan is one document's text."""
    dropped = blank if drop_blank else F.lit(False)
    indices = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("index").cast("int"))))
    rows = pages.withColumn("__gone", dropped).groupBy("stack_id").agg(F.count("*").alias("page_count"), indices(~F.col("__gone")).alias("kept"), indices(F.col("__gone")).alias("gone"))
    none = F.size("kept") == 0
    return rows.select("stack_id", "page_count", title.alias("title"), format_indices(F.col("kept")).alias("pages"), format_indices(F.col("gone")).alias("dropped_pages"), F.when(none, "every page of the scan is blank").alias("problem"))


def review_report(docs: DataFrame, key: str, order: str) -> DataFrame:
    """docs: key, order, pages, name, confidence (text), needs_review, review_reason, n_pages. One table in Markdown per key, with what is flagged."""
    flag = F.when(F.col("needs_review"), F.concat(F.lit("⚠ "), F.col("review_reason"))).otherwise("")
    line = F.format_string("| %d | %s | %s | %s | %s |", F.col(order).cast("int"), "pages", "name", "confidence", flag)
    rows = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("ls"), F.count("*").alias("n"), F.count_if("needs_review").alias("flagged"), F.sum("n_pages").alias("total"))
    head = F.format_string("%d pages, %d documents, %d flagged for review.\n\n| # | Pages | File | Confidence | Review |\n|---|---|---|---|---|\n", "total", "n", "flagged")
    return rows.select(key, F.concat(head, F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("report"))


def pages_to_write(docs: DataFrame, count: Column) -> DataFrame:
    """docs: with folder, stem, number, pages. A row per page that a document sink writes: its file, its place in it, its index in the stack. Nothing if any range of a folder is bad."""
    parsed = docs.withColumn("indices", parse_pages(F.col("pages"), count))
    bad = parsed.filter("indices is null").select("folder").distinct()
    good = unique_names(parsed.join(bad, "folder", "left_anti").select("folder", "stem", "number", "indices"), "folder", "stem", "number")
    return good.select("folder", "name", "number", F.posexplode("indices").alias("place", "index"))


def once_each(send: Callable[[DataFrame, int], None], ledger: str, arrived: Callable[[int], bool] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sends each batch, also if the stream restarts in between. The ledger is a folder with two marks per batch: claimed before it is sent, finished behind it.

    A batch that was claimed and not finished may have arrived or not, as no mark can be written together with what a service does. ``arrived`` tells, by the batch's number, which
    ``send`` hands to the service as the idempotence key; without it the batch is sent again under the same number, and the service has to drop the second one."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        claimed, finished = (spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{number}.{mark}") for mark in ("claimed", "finished"))
        files = claimed.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(finished):
            return
        known = files.exists(claimed) and arrived is not None and arrived(number)
        if not known:
            files.create(claimed, True).close()
            send(batch, number)
        files.create(finished, True).close()

    return step
