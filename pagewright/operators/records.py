"""Bookkeeping over files, chunks, jobs and queues: joins, divisions, folds, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.names import casefolded, folded
from pagewright.operators.folds import fold


def ledger_state(files: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """files: sha, file, order column; ledger: sha, document, file, pending. Adds state and document.

    recovered: uploaded before, but this same file was never archived; duplicate: uploaded before; in progress: an equal file comes earlier in this batch; else new."""
    known = ledger.select("sha", F.col("document").alias("__doc"), F.col("file").alias("__file"), F.col("pending").alias("__pending"))
    first = F.min(order).over(W.partitionBy("sha"))
    joined = files.withColumn("__first", first).join(known, "sha", "left")
    state = (
        F.when(F.col("__doc").isNotNull() & F.col("__pending") & (F.col("__file") == F.col("file")), F.lit("recovered"))
        .when(F.col("__doc").isNotNull(), F.lit("duplicate")).when(F.col(order) > F.col("__first"), F.lit("in progress")).otherwise(F.lit("new"))
    )
    return joined.withColumn("state", state).withColumn("document", F.col("__doc")).drop("__doc", "__file", "__pending", "__first")


def chunk_starts(stacks: DataFrame, size: Column | int) -> DataFrame:
    """stacks: stack_id, total. (stack_id, start, expected) of consecutive chunks; the last may be shorter."""
    step = F.lit(size) if isinstance(size, int) else size
    starts = stacks.filter("total > 0").withColumn("__size", step.cast("int"))
    each = starts.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("total").cast("int") - 1, F.col("__size"))))
    return each.select("stack_id", "start", F.least(F.col("__size"), F.col("total").cast("int") - F.col("start")).alias("expected"))


def complete_layouts(stacks: DataFrame, cached: DataFrame, default: int) -> DataFrame:
    """cached: stack_id, size, start. The chunk size to read a stack's cache with: the default if complete or if none is, else the smallest complete one.

    A size is complete if every chunk that it calls for is there: relational division by counting."""
    joined = cached.join(stacks, "stack_id")
    wanted = joined.filter((F.col("start") % F.col("size") == 0) & (F.col("start") < F.col("total")))
    full = wanted.groupBy("stack_id", "size", "total").agg(F.count_distinct("start").alias("n")).filter(F.col("n") == F.ceil(F.col("total") / F.col("size")))
    best = full.groupBy("stack_id").agg(F.min(F.struct(F.col("size") != default, "size")).alias("b")).select("stack_id", F.col("b.size").alias("__s"))
    return stacks.join(best, "stack_id", "left").select("stack_id", F.coalesce("__s", F.lit(default)).alias("size"))


def next_fit(rows: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Adds batch: rows of a key in order, a new batch wherever the next would take a batch that has rows beyond ``most``."""

    def step(state: tuple[int, int, bool], row: tuple) -> tuple[tuple[int, int, bool], tuple]:
        batch, filled, any_rows = state
        own = row[0] or 0
        if any_rows and filled + own > most:
            batch, filled = batch + 1, 0
        return (batch, filled + own, True), (batch,)

    return fold(rows.select(key, order, size), [key], [order], [size], (0, 0, False), step, {"batch": "int"})


def heartbeats(rows: DataFrame, key: str, time: str, state: str, seconds: int) -> DataFrame:
    """Rows of a key at which a report is due: its state changed since the last report, or ``seconds`` have passed since then."""

    def step(last: tuple | None, own: tuple) -> tuple[tuple | None, tuple]:
        due = last is None or own[1] != last[1] or own[0] - last[0] >= seconds
        return (own if due else last), (due,)

    due = fold(rows.select(key, time, state), [key], [time, state], [time, state], None, step, {"__due": "boolean"})
    return due.filter("__due").select(key, time, state)


def queue_snapshot(counts: DataFrame) -> DataFrame:
    """counts: profile, in_inbox, busy, failed, duplicates. Waiting and processing per profile, and their totals (profile null)."""
    own = counts.withColumn("processing", F.least("busy", "in_inbox")).withColumn("waiting", F.col("in_inbox") - F.col("processing"))
    sums = [F.sum(c).alias(c) for c in ("waiting", "processing", "failed", "duplicates")]
    return own.rollup("profile").agg(*sums).withColumn("queued", F.col("waiting") + F.col("processing"))


def expired_folders(files: DataFrame, active: DataFrame, cutoff: Column) -> DataFrame:
    """files: folder, kind, mtime, size. Finished folders (a review and a plan are there) that nothing works on and whose last change isn't after the cutoff."""
    finished = files.groupBy("folder").agg(
        F.max(F.when(F.col("kind").isin("review", "plan"), F.col("mtime"))).alias("last_change"), F.sum("size").alias("bytes"),
        F.bool_or(F.col("kind") == "review").alias("r"), F.bool_or(F.col("kind") == "plan").alias("p"),
    ).filter("r and p").drop("r", "p")
    return finished.join(active, "folder", "left_anti").filter(F.col("last_change") <= cutoff)


def old_file_action(written: DataFrame, listing: DataFrame) -> DataFrame:
    """written: name, sha (null in old plans); listing: name, sha. What becomes of each file that an earlier run wrote."""
    there = listing.select("name", F.col("sha").alias("__now"))
    joined = written.join(there, "name", "left")
    action = F.when(F.col("__now").isNull(), F.lit("gone")).when(F.col("sha").isNull(), F.lit("keep: no hash")).when(F.col("sha") != F.col("__now"), F.lit("keep: changed")).otherwise(F.lit("delete"))
    return joined.withColumn("action", action).drop("__now")


def first_error(pages: DataFrame, key: str) -> DataFrame:
    """pages: key, page, error. The first page with an error, per key."""
    bad = pages.filter(F.coalesce(F.col("error"), F.lit("")) != "")
    return bad.groupBy(key).agg(F.min(F.struct("page", "error")).alias("__e")).select(key, F.col("__e.page").alias("page"), F.col("__e.error").alias("error"))


def name_conflicts(owned: DataFrame, shared: DataFrame) -> DataFrame:
    """owned, shared: id, name. Owned objects whose name (case folded, stripped) an object without owner has; of several the one with the greatest id."""
    top = shared.groupBy(folded(F.col("name")).alias("__n")).agg(F.max("id").alias("shared_id"))
    return owned.withColumn("__n", folded(F.col("name"))).join(top, "__n", "left").drop("__n")


def shares_in_turn(objects: DataFrame, keys: list[str]) -> DataFrame:
    """objects: keys (a kind), id, place (in the service's list), name, owner, refused (whether the service won't take it for a reason of its own). Owned objects are shared one after another: what comes of one depends on those before.

    (keys, id, shared, same_name_as): an object is shared unless the service refuses it or one of exactly its name has no owner by then. One that isn't shared names the last object of its folded name that is
    without owner. Only objects of one folded name depend on each other, so a fold runs over those of each name, the ownerless ones first. A null name equals no other's."""

    def step(state: tuple[frozenset[str], int | None], row: tuple) -> tuple[tuple[frozenset[str], int | None], tuple]:
        (taken, last), (own, name, owned, refused) = state, row
        if not owned:
            return (taken | {name}, own), (None, None)
        if refused or (name is not None and name in taken):
            return state, (False, last)
        return (taken | {name}, own), (True, None)

    rows = objects.withColumns({"__name": folded(F.col("name")), "__owned": F.col("owner").isNotNull(), "__refused": F.coalesce("refused", F.lit(False))})
    rows = rows.withColumn("__alone", F.when(F.col("__name").isNull(), F.col("id")))  # so that null names don't meet
    rows = rows.select(*keys, "id", "place", "name", "__name", "__alone", "__owned", "__refused")
    done = fold(rows, [*keys, "__name", "__alone"], ["__owned", "place", "id"], ["id", "name", "__owned", "__refused"], (frozenset(), None), step, {"shared": "boolean", "same_name_as": "long"})
    return done.filter("__owned").select(*keys, "id", "shared", "same_name_as")


def share_sets(objects: DataFrame, kind: str, readonly: list[str]) -> DataFrame:
    """objects: kind, id, name, owner. Adds part: "protected" (tags whose folded name is among readonly), "owned" (others that have an owner and are to lose it), or "ownerless"."""
    wanted = sorted({x.casefold() for x in readonly})
    protected = (F.col(kind) == "tags") & F.coalesce(casefolded(F.col("name")).isin(*wanted), F.lit(False)) if wanted else F.lit(False)
    return objects.withColumn("part", F.when(protected, "protected").when(F.col("owner").isNotNull(), "owned").otherwise("ownerless"))
