"""Connected components by contraction, as joins: nothing of the graph reaches the driver.

Each round, every node takes as parent the neighbour (or itself) of least random priority, two steps of pointers are followed, and
edges between different parents go to the next round. Priorities are drawn anew each round, so that a constant share of the
nodes vanishes in each on any graph, chains included. What stands between rounds is a table in the shared folder; a round's
tables are deleted once the next round has its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import remove, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges of long nodes, a <> b. One row (node, root) for each node that has an edge; a root stands for its component."""
    spark, left, right = edges.sparkSession, F.col(a), F.col(b)
    rest, rest_path = written(edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a <> b").distinct(), "edges")
    labels, labels_path, turn = rest.select(F.col("a").alias("node"), F.col("b").alias("root")), None, 0
    while not rest.isEmpty():
        step, step_path = written(_parents(rest, turn), "parents")
        old = labels_path
        if labels_path is None:
            labels, labels_path = step, step_path
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("new"))
            labels, labels_path = written(labels.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        of_a, of_b = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = rest.join(of_a, "a").join(of_b, "b").filter("ra <> rb")
        done = [rest_path, *([old] if old else []), *([step_path] if old else [])]
        rest, rest_path = written(contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        for path in done:
            remove(spark, path)
        turn += 1
    return labels


def _parents(edges: DataFrame, turn: int) -> DataFrame:
    """node -> root: two steps up."""

    def priority(node: Column) -> Column:
        return F.xxhash64(F.lit(turn), node)

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.struct(priority(F.col("b")).alias("p"), F.col("b").alias("b"))).alias("least"))
    parents = least.select(F.col("a").alias("node"), F.when(F.col("least.p") < priority(F.col("a")), F.col("least.b")).otherwise(F.col("a")).alias("parent"))
    return parents.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("root")), "parent").select("node", "root")
