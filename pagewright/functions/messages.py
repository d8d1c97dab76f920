"""Predicates and readers for answers, messages and file heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import strip

# Which answers mean what.
LIMIT_STATUS = (401, 402, 403)
RETRY_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
OUTAGE_STATUS = (408, 429, 502, 503, 504)
QUOTA_WORDS = ("quota", "spend", "billing", "credit", "balance", "insufficient", "monthly")
NO_DETAILS = "no details"
MAGIC = (("pdf", "255044462D"), ("jpg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("tif", "49492A00"), ("tif", "4D4D002A"))


def is_limit(status: Column, body: Column) -> Column:
    """An account's limit: some statuses always; 429 if its body is an object whose message speaks of a quota and not of a rate limit."""
    kind, message = F.get_json_object(body, "$.type"), F.lower(F.coalesce(F.get_json_object(body, "$.message"), F.lit("")))
    words = F.exists(F.array(*map(F.lit, QUOTA_WORDS)), lambda w: F.contains(message, w))
    quota = F.startswith(F.ltrim(body), F.lit("{")) & (F.coalesce(kind, F.lit("")) != "rate_limited") & ~F.contains(message, F.lit("rate limit")) & words
    return F.when(status.isin(*LIMIT_STATUS), F.lit(True)).when(status != 429, F.lit(False)).otherwise(F.coalesce(quota, F.lit(False)))


def duplicate_id(message: Column) -> tuple[Column, Column]:
    """(is it about a duplicate, the id it names or null)"""
    about = message.rlike(r"(?i)\bduplicate\b")
    number = F.regexp_extract(message, r"\(#(\d+)\)", 1)
    return about, F.when(about & (number != ""), number.cast("long"))


def task_status(task: Column) -> Column:
    return F.upper(F.coalesce(F.get_json_object(task, "$.status"), F.lit("")))


def task_document(task: Column) -> Column:
    """The document's id in the newer or the older form of a task; null if none is a number."""
    found = [F.get_json_object(task, p) for p in ("$.result_data.document_id", "$.related_document_ids[0]", "$.related_document")]
    return F.coalesce(*(F.when(x.rlike(r"^\d+$"), x.cast("long")) for x in found))


def task_message(task: Column) -> Column:
    found = [F.nullif(F.get_json_object(task, p), F.lit("")) for p in ("$.result", "$.result_data", "$.status_display")]
    return F.left(F.coalesce(*found, F.lit(NO_DETAILS)), F.lit(300))


def sniff(head: Column) -> Column:
    """The kind of a file's first bytes (binary), null if unknown."""
    found = F.when(F.startswith(head, F.unhex(F.lit("52494646"))) & (F.substring(head, 9, 4) == F.unhex(F.lit("57454250"))), F.lit("webp"))
    for kind, magic in MAGIC:
        found = found.when(F.startswith(head, F.unhex(F.lit(magic))), F.lit(kind))
    return found


def looks_complete(content: Column) -> Column:
    """The end-of-file mark stands in the last 2048 bytes."""
    tail = F.substring(content, F.greatest(F.lit(1), F.length(content) - 2047), F.lit(2048))
    return F.contains(tail, F.unhex(F.lit("2525454F46")))


# Words that mark a line of a tool's output as telling.
TELLING = ("error", "exception", "failed", "errno", "not ", "cannot", "unable")


def telling_lines(output: Column, most: int = 6, chars: int = 1200) -> Column:
    """The last lines that say what went wrong (of all lines if none does), joined; at most so many lines and characters."""
    lines = F.filter(F.transform(F.split(output, "\n"), strip), lambda x: x != "")
    marked = F.filter(lines, lambda x: F.exists(F.array(*map(F.lit, TELLING)), lambda w: F.contains(F.lower(x), w)))
    chosen = F.when(F.size(marked) > 0, marked).otherwise(lines)
    last = F.slice(chosen, F.greatest(F.lit(1), F.size(chosen) - (most - 1)), F.lit(most))
    return F.right(F.array_join(last, " | "), F.lit(chars))


def answer_kind(status: Column, body: Column, attempt: Column, attempts: int) -> Column:
    """What follows from an answer: ok, limit, retry, outage or error."""
    return (
        F.when(status < 400, F.lit("ok")).when(is_limit(status, body), F.lit("limit"))
        .when(status.isin(*RETRY_STATUS) & (attempt < attempts), F.lit("retry"))
        .when(status.isin(*OUTAGE_STATUS), F.lit("outage")).otherwise(F.lit("error"))
    )


def ocr_modes(has_text: Column, tagged: Column) -> Column:
    """Ways to make a text layer, in the order to try them."""
    modes = lambda *names: F.array(*map(F.lit, names))
    return F.when(tagged, modes("plain")).when(has_text, modes("redo", "plain")).otherwise(modes("scan", "redo", "plain"))


def page_resolution(stated: Column, longest_px: Column) -> Column:
    """Dots per inch for an image's page: as stated if at least 100 and the page is at most 16.5 inches long, else from the longest side."""
    return F.when((stated >= 100) & (longest_px / stated <= 16.5), stated.cast("double")).otherwise(F.greatest(F.lit(150.0), F.least(F.lit(600.0), longest_px / F.lit(11.7))))
