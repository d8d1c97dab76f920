"""Scalar functions over page text, all JVM-side.

Classes of characters are spelled out, because \\s, \\w and \\W mean different sets in Java, in DuckDB and in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on these patterns and numbers.
WHITE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
IMAGE_REF = r"!\[[^\]]*\]\([^)]*\)"
NOISE = rf"[{WHITE}#*_|`>\-=~.:]+"
MARKER = r"(?i)\b(?:seite|page|blatt|pagina|s\.)\s*(\d{1,3})\s*(?:von|of|/|aus|de|di)\s*(\d{1,3})\b"
HEAD_CHARS = 1200
TAIL_CHARS = 400
NON_LETTERS = r"[^\p{L}\p{N}_]+"
_EDGES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGES))


def text_chars(header: Column, body: Column, footer: Column) -> Column:
    """Characters of real text: without image references, white space and markup characters."""
    whole = F.regexp_replace(F.concat_ws("\n", header, body, footer), IMAGE_REF, "")
    return F.length(F.regexp_replace(whole, NOISE, ""))


def page_marker(header: Column, body: Column, footer: Column) -> Column:
    """struct(k, n) of the first "page k of n" with 1 <= k <= n, looked for in header, footer, the body's end, its start; null if none."""

    def first_in(text: Column) -> Column:
        k, n = (F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(g)), lambda x: x.cast("int")) for g in (1, 2))
        pairs = F.zip_with(k, n, lambda a, b: F.struct(a.alias("k"), b.alias("n")))
        # one look tells most texts, which have none, apart
        return F.when(F.rlike(text, F.lit(MARKER)), F.get(F.filter(pairs, lambda p: (p["k"] >= 1) & (p["k"] <= p["n"])), 0))

    return F.coalesce(*(first_in(t) for t in (header, footer, F.right(body, F.lit(TAIL_CHARS)), F.left(body, F.lit(HEAD_CHARS // 3)))))


def excerpt(body: Column) -> Column:
    """The text with images named; of a long one the head and the tail."""
    text = strip(F.regexp_replace(body, IMAGE_REF, "[image]"))
    short = F.length(text) <= HEAD_CHARS + TAIL_CHARS
    return F.when(short, text).otherwise(F.concat(F.left(text, F.lit(HEAD_CHARS)), F.lit("\n[...]\n"), F.right(text, F.lit(TAIL_CHARS))))


def page_chunk(number: Column, header: Column, body: Column, footer: Column) -> Column:
    """One page of a document's text: its parts that aren't empty, under a heading."""
    parts = F.filter(F.array(header, F.regexp_replace(body, IMAGE_REF, ""), footer), lambda x: strip(x) != "")
    return F.concat(F.lit("--- page "), number.cast("string"), F.lit(" ---\n"), strip(F.array_join(parts, "\n")))


def clipped_text(text: Column, most: int) -> Column:
    """A text of at most ``most`` characters: three quarters from the head, the rest from the tail."""
    head = int(most * 0.75)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("\n\n[... middle omitted ...]\n\n"), F.right(text, F.lit(most - head))))


def content_block(header: Column, body: Column, footer: Column) -> Column:
    """A page's stripped parts that aren't empty, an empty line between them; empty if none."""
    parts = F.filter(F.transform(F.array(header, F.regexp_replace(body, IMAGE_REF, ""), footer), strip), lambda x: x != "")
    return F.array_join(parts, "\n\n")


def letters(text: Column) -> Column:
    """Lower case, letters, digits and underscore only."""
    return F.regexp_replace(F.lower(text), NON_LETTERS, "")


# Markup that is taken off, in this order, with what is left of it.
_EMPHASIS = r"[*_`~]+"
MARKUP = (
    (IMAGE_REF, ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (rf"(?m)^[{WHITE}]{{0,3}}#{{1,6}}[{WHITE}]*", ""),
    (rf"(?m)^[{WHITE}]*>[{WHITE}]?", ""),
    (rf"(?m)^[{WHITE}]*(?:[-*+]|\d+[.)])[{WHITE}]+", ""),
    (r"\$+([^$]*)\$+", "$1"),
    (_EMPHASIS, ""),
    (r"<[^>\n]+>", ""),
)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often it is used (and a Python function kept out of inner lambdas)."""
    return F.get(F.transform(F.array(value), then), 0)


def plain_lines(markdown: Column) -> Column:
    """The lines without markup that aren't empty, white space collapsed."""
    text = markdown
    for pattern, rest in MARKUP:  # single signs need no pattern
        text = F.translate(text, "*_`~", "") if pattern == _EMPHASIS else F.regexp_replace(text, pattern, rest)
    lines = F.split(text, r"\r\n|[\n\r\x0b\f\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]")
    tidy = F.transform(lines, lambda x: strip(F.regexp_replace(F.translate(x, "|", " "), rf"[{WHITE}]+", " ")))
    return F.filter(tidy, lambda x: x != "")
