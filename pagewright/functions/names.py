"""File names from titles, and dates."""

from __future__ import annotations

import unicodedata
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions.text import WHITE, once, strip
from pagewright.operators.folds import fold
from pagewright.workers import let_workers_import

# Limits and names that file systems reserve.
MAX_STEM = 150
MAX_STEM_BYTES = 200
# Marks of format as of Unicode 15; Java's own class has those of its release.
FORMAT_MARKS = r"[\p{Cf}\x{890}\x{891}\x{13430}-\x{1343F}]"
RESERVED = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no function for it."""
    let_workers_import()
    return F.pandas_udf(_composed, StringType())(text)


def _casefolded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold().strip())


def casefolded(text: Column) -> Column:
    """Full case folding, which neither lower nor upper case is."""
    let_workers_import()
    return F.pandas_udf(_casefolded, "string")(text)


def folded(text: Column) -> Column:
    """A name as names are compared: case folded, without white space around it."""
    let_workers_import()
    return F.pandas_udf(_folded, "string")(text)


def clip(text: Column) -> Column:
    """The longest beginning of at most MAX_STEM characters and MAX_STEM_BYTES bytes."""

    def longest(t: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.lit(MAX_STEM)), lambda i: F.octet_length(F.left(t, i)) <= MAX_STEM_BYTES)
        return F.when(F.octet_length(t) <= MAX_STEM, t).otherwise(F.left(t, F.array_max(fits)))

    return once(text, longest)


def sanitize(text: Column, compose: bool = True, reserved: bool = True) -> Column:
    """A name that every file system takes; empty if nothing is left. compose=False for text that is ASCII or composed; reserved=False for a part of a name, which may be
    one that file systems reserve."""
    clean = F.regexp_replace(nfc(text) if compose else text, FORMAT_MARKS, "")
    clean = F.regexp_replace(clean, r'[<>:"/\\|?*\x00-\x1f]', " ")
    clean = F.btrim(F.regexp_replace(clean, rf"[{WHITE}]+", " "), F.lit(" ."))
    named = once(clean, lambda t: F.when(F.upper(t).isin(*RESERVED), F.concat(F.lit("_"), t)).otherwise(t)) if reserved else clean
    return F.rtrim(clip(named), F.lit(" ."))


def build_stem(pattern: str, title: Column, date: Column, no_date: str, compose: bool = True) -> Column:
    """The pattern with {title}, then {date} filled in."""
    own = F.coalesce(F.nullif(strip(title), F.lit("")), F.lit("Document"))
    named = F.replace(F.lit(pattern), F.lit("{title}"), own)
    stem = sanitize(F.replace(named, F.lit("{date}"), F.coalesce(F.nullif(date, F.lit("")), F.lit(no_date))), compose)
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("Document"))


def unique_names(rows: DataFrame, folder: str, stem: str, order: str, suffix: str = ".pdf", existing: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: the stem, then "stem (2)", ... as each folder's rows come in order and ``existing`` (folder, name) has them not.

    The next free name depends on the names given before, but only on those of the same stem or of the stem with numbers behind it. So a fold runs over the rows of a
    folder and of a stem without such numbers, the names that exist first."""
    base = lambda c: F.regexp_replace(c, r"( \([0-9]+\))+$", "")
    own = rows.withColumns({"__base": base(F.col(stem)), "__there": F.lit(None).cast("string")})
    if existing is not None:
        kind = rows.schema[folder].dataType
        there = existing.filter(F.endswith("name", F.lit(suffix))).select(F.col("folder").cast(kind).alias(folder), F.col("name").alias("__there"))
        there = there.withColumn("__base", base(F.expr(f"left(__there, length(__there) - {len(suffix)})")))
        own = own.unionByName(there, allowMissingColumns=True)

    def give(state: tuple[set[str], dict[str, int]] | None, row: tuple) -> tuple[tuple[set[str], dict[str, int]], tuple]:
        title, there = row
        seen, next_of = state or (set(), {})
        if there is not None:
            seen.add(there)
            return (seen, next_of), (None,)
        number = next_of.get(title, 1)
        while (name := f"{title}{suffix}" if number == 1 else f"{title} ({number}){suffix}") in seen:
            number += 1
        next_of[title] = number + 1
        seen.add(name)
        return (seen, next_of), (name,)

    own = own.withColumn("__own", F.col("__there").isNull())  # false sorts first
    made = fold(own, [folder, "__base"], ["__own", order], [stem, "__there"], None, give, {"name": "string"})
    return made.filter("__own").select(*rows.columns, "name")


def is_inside(folder: Column) -> Column:
    """Whether a folder's name stays inside of the tree that it is put in: no absolute path, and no ".." that climbs above the root on the way."""
    step = lambda depth, part: F.when(depth < 0, depth).when(part == "..", depth - 1).when(part.isin("", "."), depth).otherwise(depth + 1)
    return ~F.startswith(folder, F.lit("/")) & (F.aggregate(F.split(folder, "/"), F.lit(0), step) >= 0)


def normalize_date(value: Column) -> Column:
    """A real calendar date in ISO form, as text; else null."""
    own = strip(value)
    shaped = own.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~F.startswith(own, F.lit("0000"))
    return F.when(shaped & F.try_to_date(own, "yyyy-MM-dd").isNotNull(), own)
