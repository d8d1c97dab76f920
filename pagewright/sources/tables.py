"""Stacks of pages from tables of conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.operators.segmentation import CONFIDENCE
from pagewright.session import table


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a stack and a turn a page; a user's turn opens a document, with a confidence from its length."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "stack_id")  # before the window, so that its exchange serves what follows
    index = F.row_number().over(W.partitionBy("stack_id").orderBy("turn", "role", "text")) - 1
    return rows.select(
        "stack_id", index.alias("index"), F.coalesce("text", F.lit("")).alias("markdown"), F.lit("").alias("header"), F.lit("").alias("footer"),
        F.lit(False).alias("has_images"), F.lit(None).cast("double").alias("ink"), (F.col("role") == "user").alias("starts_new"),
        ((F.lit(50) + F.length(F.coalesce("text", F.lit(""))) % 50) / F.lit(100)).cast(CONFIDENCE).alias("confidence"), F.concat(F.lit("role "), "role").alias("reason"),
    )


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a stack and a line a page; headers, footers, images and ink follow from the line's number and length."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stack_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("index", "markdown"))
    i = F.col("index")
    k, n = (i % 4 + 1).cast("string"), (i % 3 + 2).cast("string")
    return rows.select(
        "stack_id", "index", "markdown",
        F.when(i % 3 == 0, F.concat(F.lit("Seite "), k, F.lit(" von 3"))).otherwise("").alias("header"),
        F.when(i % 5 == 0, F.concat(F.lit("Blatt "), (i % 3 + 1).cast("string"), F.lit(" / "), n)).otherwise("").alias("footer"),
        (i % 7 == 0).alias("has_images"),
        F.when(i % 6 != 0, (F.length("markdown") % 50) / F.lit(10000.0)).alias("ink"),
    )
