"""What recognition and language models do, behind functions that can be replaced; the ones here are deterministic.

A model step is a column expression over a document's or page's text, so a deployment swaps in a pandas UDF that calls its service. What calls a service once per request
(``chat``, ``recognise``) takes a function and runs it on the executors, over requests that a cache doesn't hold."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.names import normalize_date
from pagewright.functions.text import strip
from pagewright.operators.records import chunk_starts
from pagewright.operators.service import answered, request_key
from pagewright.sources.recognition import decode_chunks
from pagewright.workers import let_workers_import

#: (system prompt, what the user says, schema, name of the request) -> an object that JSON can hold
Chat = Callable[[str, str, str, str], dict]
#: (content of a file, first page, number of pages) -> pages, as decode_chunks takes them
Recognise = Callable[[bytes, int, int], list[dict]]


def chat(requests: DataFrame, cache: DataFrame, model: str, ask: Chat) -> tuple[DataFrame, DataFrame]:
    """requests: system, user, schema, name; cache: key, answer. (requests with key and answer, what is new in the cache): equal requests are asked once, cached ones never."""

    def call(missing: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(ask(*r), ensure_ascii=False, sort_keys=True) for r in rows], pa.string())], names=["key", "answer"])

        return missing.select("key", "system", "user", "schema", "name").mapInArrow(run, "key string, answer string")

    let_workers_import(requests.sparkSession)
    keyed = requests.withColumn("key", request_key(F.lit(model), *(F.col(c) for c in ("name", "system", "user", "schema"))))
    return answered(keyed, cache, call)


def recognise(files: DataFrame, stacks: DataFrame, cached: DataFrame, size: int, read: Recognise, batched: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files: stack_id, content; stacks: stack_id, total (pages); cached and batched (a batch job's results): stack_id, start, answer.

    (pages, what is new in the cache). Chunks come from the cache, then from the batch, and only the rest is read directly. A chunk with another number of pages than it should have
    gives no pages but a row with a problem."""
    let_workers_import(stacks.sparkSession)
    starts = chunk_starts(stacks, size)
    known = cached.select("stack_id", "start", "answer")
    if batched is not None:
        known = known.unionByName(batched.filter("answer IS NOT NULL").select(known.columns).join(known, ["stack_id", "start"], "left_anti"))
    missing = starts.join(known, ["stack_id", "start"], "left_anti").join(files, "stack_id")
    kind, first = missing.schema["stack_id"].dataType.simpleString(), missing.schema["start"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(read(content, start, n), ensure_ascii=False) for start, n, content in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["stack_id", "start", "answer"])

    direct = missing.select("stack_id", "start", "expected", "content").mapInArrow(run, f"stack_id {kind}, start {first}, answer string")
    every = starts.join(known.unionByName(direct), ["stack_id", "start"])
    counted = every.withColumn("got", F.coalesce(F.json_array_length("answer"), F.lit(0)))
    good = decode_chunks(counted.filter("got = expected")).withColumn("problem", F.lit(None).cast("string"))
    bad = counted.filter("got <> expected").select("stack_id", F.col("start").cast("int").alias("index"), F.format_string("answer has %d pages instead of %d", "got", "expected").alias("problem"))
    fresh = known.join(cached, ["stack_id", "start"], "left_anti").unionByName(direct)
    return good.unionByName(bad, allowMissingColumns=True), fresh


def describe(text: Column) -> tuple[Column, ...]:
    """title, date of a document's text: words of its first line, the first ISO date that is one."""
    first = F.regexp_extract(text, r"^--- page [0-9]+ ---\n([^\n]*)", 1)
    title = strip(F.left(F.regexp_replace(first, r"[^A-Za-z0-9 ]+", ""), F.lit(40)))
    date = normalize_date(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    return title.alias("title"), date.alias("date")


def letter_verdict(text: Column) -> tuple[Column, ...]:
    """starts_new, confidence, reason of a page: a stand-in that opens a document at "LETTER" and doubts where the page says "unsure"."""
    unsure = F.contains(text, F.lit("unsure"))
    return F.startswith(text, F.lit("LETTER")).alias("starts_new"), F.when(unsure, 0.5).otherwise(0.95).cast("decimal(6,4)").alias("confidence"), F.lit("stand-in").alias("reason")
