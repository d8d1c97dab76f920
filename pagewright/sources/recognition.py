"""Pages as a recognition service answers them: JSON in chunks, to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "index int, markdown string, header string, footer string, images array<string>"


def decode_chunks(chunks: DataFrame, answer: str = "answer") -> DataFrame:
    """chunks: stack_id, start, answer (a JSON array of pages). One row per page; missing texts are empty, and the index counts from the stack's first page by the page's place among the chunk's own, in order of their index."""
    read = chunks.select("stack_id", "start", F.from_json(answer, f"array<struct<{PAGE.replace(' ', ':').replace(',:', ',')}>>").alias("pages"))
    ordered = F.array_sort(F.transform("pages", lambda p, i: F.struct(F.coalesce(p["index"], F.lit(0)).alias("n"), i.alias("i"), p.alias("p"))))
    each = read.select("stack_id", "start", F.posexplode(ordered).alias("place", "x"))
    text = lambda f: F.coalesce(F.col(f"x.p.{f}"), F.lit("")).alias(f)
    return each.select("stack_id", (F.col("start") + F.col("place")).cast("int").alias("index"), text("markdown"), text("header"), text("footer"), (F.coalesce(F.size("x.p.images"), F.lit(0)) > 0).alias("has_images"))


def short_chunks(pages: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """chunks: stack_id, start, expected. Those whose answers don't have as many pages as they should."""
    got = pages.groupBy("stack_id", (F.floor(F.col("index") / size) * size).cast("int").alias("start")).agg(F.count("*").alias("got"))
    return chunks.join(got, ["stack_id", "start"], "left").withColumn("got", F.coalesce("got", F.lit(0))).filter(F.col("got") != F.col("expected"))


def max_dpi(images: DataFrame, key: str) -> DataFrame:
    """images: key, dpi_x, dpi_y. The greatest resolution of a file's images, 0 without any."""
    return images.groupBy(key).agg(F.coalesce(F.max(F.greatest("dpi_x", "dpi_y")), F.lit(0.0)).alias("dpi"))


def only_known(problems: Column, known: list[str]) -> Column:
    """All problems of a file are such as its source had."""
    return F.size(F.array_except(problems, F.array(*map(F.lit, known)))) == 0
