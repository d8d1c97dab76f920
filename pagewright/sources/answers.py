"""Answers of a service, bodies without a fixed schema, as VARIANT values: lines of JSON that may be broken, of other shapes or without a body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(line: Column) -> Column:
    """A line of JSON as a variant; null where it is none."""
    return F.try_parse_json(line)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def batch_answers(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines: the lines of a batch job's output. (custom_id, body): the body of each request that succeeded, as a variant; of an id that comes twice the last line in the order of ``number``, if there is one, counts.

    Left out are lines that are no JSON, answers with another status than 200, and bodies that are null, missing or no object."""
    value = F.col("__v")
    rows = lines.withColumn("__v", parsed(F.col(line)))
    own = rows.select(
        F.try_variant_get(value, "$.custom_id", "string").alias("custom_id"), F.try_variant_get(value, "$.response.status_code", "int").alias("status"), F.try_variant_get(value, "$.response.body", "variant").alias("body"),
        *(["number"] if "number" in lines.columns else []),
    )
    good = own.where((F.col("status") == 200) & F.col("custom_id").isNotNull() & is_object(F.col("body")))
    if "number" not in lines.columns:
        return good.select("custom_id", "body")
    # a variant can't be compared: the last line's number, and then its body
    last = F.max_by(F.to_json("body"), "number")
    return good.groupBy("custom_id").agg(last.alias("__body")).select("custom_id", F.parse_json("__body").alias("body"))


def schema_of(answers: DataFrame, body: str = "body") -> Column:
    """What all bodies have in common, as text: to see what a service sends before fields are chosen."""
    return answers.agg(F.schema_of_variant_agg(body).alias("schema")).scalar()


def field(body: Column, path: str, kind: str) -> Column:
    """A field of a body; null where it is missing or of another kind."""
    return F.try_variant_get(body, path, kind)
