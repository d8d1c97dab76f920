"""Page ranges like "1-3, 5": from rows of pages to text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def format_pages(rows: DataFrame, keys: list[str], index: str, name: str = "pages") -> DataFrame:
    """One row per keys: the ranges of the 0-based indices, as 1-based text. Runs are islands of index minus rank."""
    distinct = rows.select(*keys, F.col(index).cast("long").alias("__i")).distinct()
    island = distinct.withColumn("__g", F.col("__i") - F.row_number().over(W.partitionBy(*keys).orderBy("__i")))
    runs = island.groupBy(*keys, "__g").agg((F.min("__i") + 1).alias("__a"), (F.max("__i") + 1).alias("__b"))
    text = F.when(F.col("__a") == F.col("__b"), F.col("__a").cast("string")).otherwise(F.concat_ws("-", F.col("__a").cast("string"), F.col("__b").cast("string")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("__a").alias("a"), text.alias("t")))), lambda x: x["t"])
    return runs.groupBy(*keys).agg(F.array_join(ordered, ", ").alias(name))


def format_indices(indices: Column) -> Column:
    """The same from an array of 0-based indices in one row: a fold over the sorted array."""
    start = F.struct(F.lit("").alias("t"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))

    def shown(acc: Column) -> Column:
        run = F.when(acc["a"] == acc["b"], acc["a"].cast("string")).otherwise(F.concat_ws("-", acc["a"].cast("string"), acc["b"].cast("string")))
        return F.when(acc["a"].isNull(), acc["t"]).when(acc["t"] == "", run).otherwise(F.concat_ws(", ", acc["t"], run))

    def step(acc: Column, i: Column) -> Column:
        n = i.cast("long") + 1
        goes_on = F.coalesce(n == acc["b"] + 1, F.lit(False))
        return F.when(goes_on, F.struct(acc["t"].alias("t"), acc["a"].alias("a"), n.alias("b"))).otherwise(F.struct(shown(acc).alias("t"), n.alias("a"), n.alias("b")))

    return F.aggregate(F.array_sort(F.array_distinct(indices)), start, step, shown)


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda x: F.trim(x) != "")


def pages_valid(text: Column, count: Column) -> Column:
    """Every part is a number or a range within 1..count, and there is one."""

    def good(part: Column) -> Column:
        first = F.try_to_number(F.regexp_extract(part, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 1), F.lit("999999999"))
        last = F.coalesce(F.try_to_number(F.regexp_extract(part, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 2), F.lit("999999999")), first)
        return F.coalesce((first >= 1) & (first <= last) & (last <= count), F.lit(False))

    return (F.size(_parts(text)) > 0) & F.forall(_parts(text), good)


def parse_pages(text: Column, count: Column) -> Column:
    """The 0-based indices in the order written, repeated ones too; null if the text isn't valid."""

    def expand(part: Column) -> Column:
        first = F.regexp_extract(part, r"(\d{1,9})", 1).cast("long")
        last = F.coalesce(F.nullif(F.regexp_extract(part, r"-\s*(\d{1,9})", 1), F.lit("")).cast("long"), first)
        return F.sequence(first - 1, last - 1)

    return F.when(pages_valid(text, count), F.flatten(F.transform(_parts(text), expand)))
