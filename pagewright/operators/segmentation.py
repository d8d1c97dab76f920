"""From pages to documents: blank filter, overlapping windows, verdicts, markers, segments, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.text import page_marker, text_chars

# Limits of the rules.
BLANK_MAX_CHARS = 15
BLANK_MAX_INK = 0.002
NEARLY_EMPTY_CHARS = 60
MARKER_CONFIDENCE = "0.97"
REVIEW_CONFIDENCE = "0.80"
CONFIDENCE = "decimal(6,4)"


def _stack():
    return W.partitionBy("stack_id")


def dec(value: str) -> Column:
    """Confidences are decimals: sums and rounding are the same everywhere."""
    return F.lit(value).cast(CONFIDENCE)


def is_blank(max_chars: int = BLANK_MAX_CHARS, max_ink: float = BLANK_MAX_INK) -> Column:
    """Little ink decides first; without a measurement or with enough ink, a page is blank if it has neither images nor text."""
    no_ink = F.coalesce(F.col("ink") < max_ink, F.lit(False))
    return no_ink | (~F.col("has_images") & (text_chars(F.col("header"), F.col("markdown"), F.col("footer")) <= max_chars))


def content_positions(pages: DataFrame, blank: Column | None = None) -> DataFrame:
    """Pages that aren't blank, with pos among them (from 0) and their number in the stack."""
    kept = pages.filter(~(is_blank() if blank is None else blank))
    return kept.withColumns({"pos": F.row_number().over(_stack().orderBy("index")) - 1, "n_content": F.count("*").over(_stack())})


def window_starts(count: Column, window: int, step: int) -> Column:
    """Starts of windows of ``window`` positions every ``step``, the last one flush with the end."""
    regular = F.sequence(F.lit(0), F.greatest(F.lit(0), count - window), F.lit(step))
    return F.when(count <= window, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(count - window))))


def window_members(stacks: DataFrame, window: int, step: int) -> DataFrame:
    """stacks: stack_id, n_content. (stack_id, n_content, start, pos): exploded, so that no range join is needed."""
    starts = stacks.select("stack_id", F.col("n_content").cast("int").alias("n_content"), F.explode(window_starts(F.col("n_content").cast("int"), window, step)).alias("start"))
    return starts.withColumn("pos", F.explode(F.sequence("start", F.least(F.col("start") + window, F.col("n_content")) - 1)))


def with_margin(members: DataFrame, window: int) -> DataFrame:
    """How much context a position has in a window; an edge that is the stack's own costs none."""
    last = F.least(F.col("start") + window, F.col("n_content")) - 1
    left = F.when(F.col("start") > 0, F.col("pos") - F.col("start")).otherwise(F.lit(window))
    right = F.when(last < F.col("n_content") - 1, last - F.col("pos")).otherwise(F.lit(window))
    return members.withColumn("margin", F.least(left, right))


def best_windows(members: DataFrame, window: int) -> DataFrame:
    """(stack_id, pos, start) of the window with most context for each position; the earliest of equals."""
    best = F.row_number().over(W.partitionBy("stack_id", "pos").orderBy(F.col("margin").desc(), "start"))
    return with_margin(members, window).withColumn("__rank", best).filter("__rank = 1").select("stack_id", "pos", "start")


def select_verdicts(members: DataFrame, answers: DataFrame, window: int) -> DataFrame:
    """One verdict per position: the best window's answer, else the first window's that answered, else none given.

    answers: stack_id, start, pos, starts_new, confidence, reason."""
    ranked = with_margin(members, window)
    order = W.partitionBy("stack_id", "pos")
    best = ranked.withColumn("is_best", F.row_number().over(order.orderBy(F.col("margin").desc(), "start")) == 1)
    joined = best.join(answers, ["stack_id", "start", "pos"], "left")
    usable = F.col("starts_new").isNotNull()
    first = F.row_number().over(order.orderBy((usable & F.col("is_best")).desc(), usable.desc(), "start"))
    chosen = joined.withColumn("__rank", first).filter("__rank = 1")
    return chosen.select(
        "stack_id", "pos",
        F.coalesce("starts_new", F.lit(False)).alias("starts_new"),
        F.greatest(dec("0"), F.least(dec("1"), F.coalesce("confidence", dec("0")))).alias("confidence"),
        F.when(usable, F.left(F.coalesce("reason", F.lit("")), F.lit(200))).otherwise(F.lit("no answer from model")).alias("reason"),
    )


def apply_markers(pages: DataFrame) -> DataFrame:
    """pages with starts_new, confidence, reason: "page 1 of n" opens a document, "page k of n" never does; the stack's first page always opens one."""
    marked = pages.withColumn("__m", page_marker(F.col("header"), F.col("markdown"), F.col("footer")))
    k, n = F.col("__m.k"), F.col("__m.n")
    opens, goes_on = (k == 1) & (n > 1), k > 1
    sure = F.greatest(F.col("confidence"), dec(MARKER_CONFIDENCE))
    out = marked.withColumns({
        "starts_new": F.when(opens, F.lit(True)).when(goes_on, F.lit(False)).otherwise(F.col("starts_new")),
        "reason": F.when(opens, F.lit("page marker 1 of n")).when(goes_on, F.lit("page marker k of n, k > 1")).otherwise(F.col("reason")),
        "confidence": F.when(opens | goes_on, sure).otherwise(F.col("confidence")),
    })
    first = F.row_number().over(_stack().orderBy("index")) == 1
    return out.withColumn("__first", first).withColumns({
        "starts_new": F.col("__first") | F.col("starts_new"),
        "confidence": F.when(F.col("__first"), dec("1")).otherwise(F.col("confidence")),
        "reason": F.when(F.col("__first"), F.lit("first page of stack")).otherwise(F.col("reason")),
    }).drop("__m", "__first")


def with_segments(pages: DataFrame) -> DataFrame:
    """Adds seg: how many documents have begun up to a page."""
    return pages.withColumn("seg", F.sum(F.col("starts_new").cast("int")).over(_stack().orderBy("index").rowsBetween(W.unboundedPreceding, 0)))


def segments(pages: DataFrame, **more: Column) -> DataFrame:
    """One row per (stack_id, seg): first_index, n_pages, indices, start_* of the opening verdict, join_* of the weakest other one (the earliest of equals).

    more: other aggregates by name. The window and the aggregation share one exchange by stack."""
    verdict = F.struct("confidence", "index", "reason")
    grouped = with_segments(pages).groupBy("stack_id", "seg").agg(
        F.min("index").alias("first_index"), F.count("*").alias("n_pages"), F.array_sort(F.collect_list("index")).alias("indices"),
        F.min(F.when(F.col("starts_new"), F.struct("index", "confidence", "reason"))).alias("start"),
        F.min(F.when(~F.col("starts_new"), verdict)).alias("weakest"), *(c.alias(n) for n, c in more.items()),
    )
    return grouped.select(
        "stack_id", "seg", "first_index", "n_pages", "indices",
        F.col("start.confidence").alias("start_confidence"), F.col("start.reason").alias("start_reason"),
        F.col("weakest.index").alias("join_index"), F.col("weakest.confidence").alias("join_confidence"), F.col("weakest.reason").alias("join_reason"), *more,
    )


def document_confidence() -> Column:
    return F.round(F.least(F.col("start_confidence"), F.coalesce("join_confidence", dec("1"))), 2).cast("decimal(4,2)")


def review_reason(threshold: str = REVIEW_CONFIDENCE) -> Column:
    """Over segments with first_header, first_markdown, first_footer: why a person should look, empty if nothing."""
    header, body, footer = F.col("first_header"), F.col("first_markdown"), F.col("first_footer")
    marker = page_marker(header, body, footer)
    two = lambda c: F.round(c, 2).cast("decimal(4,2)").cast("string")
    return F.concat_ws(
        "; ",
        F.when(marker["k"] > 1, F.concat(F.lit("starts with page "), marker["k"].cast("string"), F.lit(" of "), marker["n"].cast("string"), F.lit("; earlier pages missing or misplaced"))),
        F.when((F.col("n_pages") == 1) & (text_chars(header, body, footer) < NEARLY_EMPTY_CHARS), F.concat(F.lit("single, nearly empty page "), (F.col("first_index") + 1).cast("string"))),
        F.when(F.col("start_confidence") < dec(threshold), F.concat(F.lit("uncertain split before page "), (F.col("first_index") + 1).cast("string"), F.lit(" ("), two(F.col("start_confidence")), F.lit(": "), F.col("start_reason"), F.lit(")"))),
        F.when(F.col("join_confidence") < dec(threshold), F.concat(F.lit("uncertain continuation at page "), (F.col("join_index") + 1).cast("string"), F.lit(" ("), two(F.col("join_confidence")), F.lit(": "), F.col("join_reason"), F.lit(")"))),
    )


def with_first_page(segs: DataFrame, pages: DataFrame) -> DataFrame:
    first = pages.select("stack_id", F.col("index").alias("first_index"), *(F.col(c).alias(f"first_{c}") for c in ("header", "markdown", "footer")))
    return segs.join(first, ["stack_id", "first_index"])


def attach_blanks(pages: DataFrame) -> DataFrame:
    """pages: stack_id, index, seg (null where blank). Each blank page joins the last segment that began before it, else the first: an as-of fill, no range join."""
    before = F.last("seg", ignorenulls=True).over(_stack().orderBy("index").rowsBetween(W.unboundedPreceding, 0))
    return pages.withColumn("owner", F.coalesce(before, F.min("seg").over(_stack())))


def ordered_pieces(piece: Column, separator: str) -> Column:
    """An aggregate: the pieces of a group's pages in the order of their index, those that aren't empty."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("index").alias("i"), piece.alias("t")))), lambda x: x["t"])
    return F.array_join(F.filter(parts, lambda x: x != ""), separator)


def document_texts(pages: DataFrame, keys: list[str], piece: Column, separator: str) -> DataFrame:
    return pages.groupBy(*keys).agg(ordered_pieces(piece, separator).alias("text"))
