"""What stands around calls of services: which requests are new, when they may start, when they are tried again, and what becomes of jobs, files and rights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.names import unique_names

# The longest waits, in seconds.
MOST_DELAY = 60.0
MOST_RETRY_AFTER = 120.0
#: Lengths that a page's running head and foot, and a verdict's reason, are cut to.
EDGE_CHARS = 300
REASON_CHARS = 200


def retry_delay(attempt: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds before the next attempt: twice as long each time, with jitter (0 to 1); longer if the answer's Retry-After (text) is a number that asks for it."""
    doubled = F.least(F.lit(MOST_DELAY), F.pow(F.lit(2.0), attempt)) + jitter
    number = F.when(retry_after.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.trim(retry_after).try_cast("double"))
    asked = F.when(number.isNotNull(), F.least(number, F.lit(MOST_RETRY_AFTER)))  # least alone would leave out the null
    return F.greatest(doubled, asked)  # which leaves out nulls


def spaced_starts(requests: DataFrame, key: str, order: list[str], arrival: str, interval: float) -> DataFrame:
    """Adds start: requests of a key start in order, not before they arrive and at least ``interval`` after the one before.

    start(i) = max over j <= i of arrival(j) + (i - j) * interval, so a running maximum gives it, without a fold."""
    in_order = W.partitionBy(key).orderBy(*order)
    i = F.row_number().over(in_order)
    numbered = requests.withColumn("__i", i)
    latest = F.max(F.col(arrival) - F.col("__i") * interval).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn("start", latest + F.col("__i") * interval).drop("__i")


def request_key(*parts: Column) -> Column:
    """The name of a request in a cache: a hash of the model, its purpose and all it is told."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p, F.lit("")) for p in parts))), 256)


def answered(requests: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """requests: key and what a request says (equal keys say the same); cache: key, answer. ask: rows of key and the request to rows of key, answer.

    (requests with answer, what is new in the cache). Only requests that aren't cached are asked, each once: write the second frame to the cache before both are used, as a model
    may answer otherwise when it is asked again."""
    missing = requests.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = ask(missing).select("key", "answer")
    return requests.join(cache.select("key", "answer").unionByName(fresh), "key", "left"), fresh


def window_payloads(pages: DataFrame, members: DataFrame, marker: Column, text: Column) -> DataFrame:
    """pages: stack_id, pos, index and texts; members: stack_id, start, pos. One request per window: its pages as JSON text, in order; marker is text or null."""
    edge = lambda c: F.nullif(F.left(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(EDGE_CHARS)), F.lit(""))
    page = F.struct((F.col("index") + 1).alias("page"), marker.alias("page_marker"), edge("header").alias("header"), edge("footer").alias("footer"), text.alias("text"))
    rows = pages.withColumn("page", page).join(members, ["stack_id", "pos"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "page"))), lambda x: x["page"])
    return rows.groupBy("stack_id", "start").agg(listed.alias("pages")).select("stack_id", "start", F.to_json("pages", {"ignoreNullFields": "false"}).alias("payload"))


def window_answers(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """answers: stack_id, start, answer (JSON text); asked: stack_id, start, index. Verdicts on pages that were asked about: what names another page is dropped, confidence is kept within 0 and 1,
    and reasons are cut; of a page named twice the last counts."""
    schema = "struct<pages:array<struct<page:int,starts_new_document:boolean,confidence:double,reason:string>>>"
    each = answers.select("stack_id", "start", F.posexplode(F.from_json("answer", schema)["pages"]).alias("place", "p"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("p.confidence"), F.lit(0.0))))
    rows = each.select(
        "stack_id", "start", "place", (F.col("p.page") - 1).alias("index"), F.coalesce(F.col("p.starts_new_document"), F.lit(False)).alias("starts_new"), confidence.alias("confidence"),
        F.left(F.coalesce(F.col("p.reason"), F.lit("")), F.lit(REASON_CHARS)).alias("reason"),
    )
    last = rows.groupBy("stack_id", "start", "index").agg(F.max(F.struct("place", "starts_new", "confidence", "reason")).alias("v"))
    return last.join(asked, ["stack_id", "start", "index"], "left_semi").select("stack_id", "start", "index", "v.starts_new", "v.confidence", "v.reason")


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those that were running wait again."""
    running = F.col("status") == "running"
    return jobs.withColumns({"started_at": F.when(~running, F.col("started_at")), "status": F.when(running, "queued").otherwise(F.col("status"))})


def claimed(jobs: DataFrame, started_at: Column) -> DataFrame:
    """Jobs after the oldest one that waits has been started."""
    first = jobs.filter("status = 'queued'").agg(F.min(F.struct("created_at", "id"))["id"].alias("id")).scalar()
    mine = F.coalesce(F.col("id") == first, F.lit(False))
    return jobs.withColumns({"started_at": F.when(mine, started_at).otherwise(F.col("started_at")), "status": F.when(mine, "running").otherwise(F.col("status"))})


def callbacks(jobs: DataFrame) -> DataFrame:
    """What the callers of finished jobs are told: url, id and the body as JSON text; nobody who gave no url."""
    done = jobs.filter("status IN ('done', 'failed') AND coalesce(callback_url, '') <> ''")
    body = F.struct("id", F.when(F.col("status") == "done", "ok").otherwise("failed").alias("status"), F.coalesce("error", F.lit("")).alias("message"), "links")
    return done.select(F.col("callback_url").alias("url"), "id", F.to_json(body).alias("body"))


def routes(files: DataFrame, order: str) -> DataFrame:
    """files: folder, stem, suffix, outcome, order. Where a file goes when it is done with: below archive, failed or duplicates, in its own folder, under a name that is free there."""
    root = F.when(F.col("outcome") == "done", "archive").when(F.col("outcome") == "duplicate", "duplicates").otherwise("failed")
    placed = files.withColumn("target", F.concat_ws("/", root, F.nullif(F.col("folder"), F.lit("")), F.lower("suffix")))  # names of one suffix are apart from those of others
    named = unique_names(placed, "target", "stem", order, suffix="")
    return named.withColumn("target", F.concat(F.concat_ws("/", root, F.nullif(F.col("folder"), F.lit("")), "name"), F.coalesce("suffix", F.lit("")))).drop("name")


def permission_changes(objects: DataFrame, users: DataFrame) -> DataFrame:
    """objects: id, owner, viewers, changers, groups (arrays of ids); users: id. One row per object whose owner is to be the only one who changes it and the only user not named a viewer: the viewers to
    set. Objects without an owner have no one to be handed back to, and stay."""
    every = users.agg(F.array_sort(F.collect_set("id")).alias("ids")).scalar()  # the users of one service
    owned = objects.filter("owner IS NOT NULL").withColumn("__every", every).withColumn("wanted", F.filter("__every", lambda u: u != F.col("owner")))
    as_wanted = (F.array_sort(F.coalesce("viewers", F.array().cast("array<bigint>"))) == F.col("wanted")) & (F.coalesce(F.size("changers"), F.lit(0)) <= 0) & (F.coalesce(F.size("groups"), F.lit(0)) <= 0)
    return owned.filter(~as_wanted).select("id", "owner", F.col("wanted").alias("viewers"))


def token_owner(requests: DataFrame, tokens: DataFrame, prefix: str) -> DataFrame:
    """requests: token; tokens: name, sha256. Adds name: that of the token, null for one that isn't known. Of a token listed twice the last name counts. Only hashes are compared."""
    known = tokens.groupBy("sha256").agg(F.max("name").alias("name"))
    digest = F.when(F.startswith("token", F.lit(prefix)), F.sha2(F.col("token"), 256))
    return requests.withColumn("__digest", digest).join(known.withColumnRenamed("sha256", "__digest"), "__digest", "left").drop("__digest")


def with_ink(pages: DataFrame, ink: DataFrame) -> DataFrame:
    """pages: stack_id, index; ink: stack_id, index, ink. Pages with their ink, and a problem where a stack's measurements aren't one per page."""
    counts = pages.groupBy("stack_id").agg(F.count("*").alias("__pages")).join(ink.groupBy("stack_id").agg(F.count("*").alias("__inks")), "stack_id", "left")
    joined = pages.join(ink, ["stack_id", "index"], "left").join(counts, "stack_id")
    differ = F.coalesce("__inks", F.lit(0)) != F.col("__pages")
    return joined.withColumn("problem", F.when(differ, F.lit("ink measurement and text disagree on the page count"))).drop("__pages", "__inks")


def page_texts(layer: DataFrame, read: DataFrame, source: Column) -> DataFrame:
    """The pages' texts from the source that each stack is set to: its text layer (stack_id, index, text), whose pages count as pictures so that only their ink makes them blank, or what was read (stack_id, index,
    markdown, header, footer, has_images). source is "layer" or not, from stack_id."""
    plain = layer.filter(source == "layer").select("stack_id", "index", F.col("text").alias("markdown"), F.lit("").alias("header"), F.lit("").alias("footer"), F.lit(True).alias("has_images"))
    return plain.unionByName(read.filter(F.coalesce(source != "layer", F.lit(True))).select(plain.columns))


def expired_uploads(files: DataFrame, active: DataFrame, cutoff: Column, days: int) -> DataFrame:
    """files: folder, kind, mtime, size. Work folders of uploads that failed: a searchable file, no upload that is still followed, nothing changed since the cutoff. With 0 days none."""
    made = files.groupBy("folder").agg(F.max("mtime").alias("last_change"), F.sum("size").alias("bytes"), F.bool_or(F.col("kind") == "searchable").alias("s"), F.bool_or(F.col("kind") == "upload").alias("u"))
    old = made.filter(F.col("s") & ~F.col("u") & (F.col("last_change") <= cutoff) & F.lit(days > 0)).drop("s", "u")
    return old.join(active, "folder", "left_anti")


def expired_temporary(entries: DataFrame, now: Column, days: int, keep_days: int = 2) -> DataFrame:
    """entries: name, mtime, size. Temporary entries unchanged for keep_days; with 0 days of retention nothing goes."""
    old = entries.groupBy("name").agg(F.max("mtime").alias("last_change"), F.sum("size").alias("bytes"))
    return old.filter((F.col("last_change") <= now - F.make_interval(days=F.lit(keep_days))) & F.lit(days > 0))


#: Fields that a logging framework sets by itself: of an event's own fields, these are left out.
RESERVED = ("name", "msg", "args", "levelname", "levelno", "pathname", "filename", "module", "exc_info", "exc_text", "stack_info", "lineno", "funcName", "created", "msecs", "relativeCreated", "thread", "threadName", "processName", "process", "taskName", "message", "asctime", "color_message")


def log_lines(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """events: at (timestamp), level, event, source, fields (map of texts). Each as one line of JSON: time, level, event, then its own fields without reserved ones, hidden ones and those that would
    stand there twice; and the source unless a field says it. keep: columns to keep beside the line."""
    own = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*RESERVED, "ts", "level", "event") & ~F.startswith(k, F.lit("_")) & ~((k == "pageno") & v.isNull()))
    head = F.create_map(F.lit("ts"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit("level"), F.col("level"), F.lit("event"), F.col("event"))
    tail = F.when(F.col("source").isNotNull() & ~F.map_contains_key("own", F.lit("source")), F.create_map(F.lit("source"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>"))
    return events.withColumn("own", own).select(*(keep or []), F.to_json(F.map_concat(head, "own", tail), {"ignoreNullFields": "false"}).alias("line"))
