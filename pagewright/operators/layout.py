"""Boxes, words and lines on a page: scaling, placing, spreading, medians, histograms, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits of the rules.
NOISE_CONFIDENCE = 0.6
SKIPPED_KINDS = ("table", "image")
INK_MARGIN = 40
DARK_PAPER = 128


def normalise_blocks(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """blocks: page, block_no, kind, x1, y1, x2, y2, dim_w, dim_h. Boxes scaled to the page image, clamped, in order; tables, images and slivers go.

    Coordinates of at most 1 on a whole page are shares of it."""
    corners = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("x1", "y1", "x2", "y2")]
    shares = F.max(F.greatest(*corners)).over(W.partitionBy("page")) <= 1.0
    scale = lambda size, dim: F.when(shares, F.lit(size)).otherwise(F.coalesce(F.lit(size) / F.nullif(F.col(dim), F.lit(0.0)), F.lit(1.0)))
    sx, sy = scale(width, "dim_w"), scale(height, "dim_h")
    a, b = F.greatest(F.lit(0.0), F.col("x1") * sx), F.least(F.lit(width), F.col("x2") * sx)
    c, d = F.greatest(F.lit(0.0), F.col("y1") * sy), F.least(F.lit(height), F.col("y2") * sy)
    boxes = blocks.withColumns({"left": F.least(a, b), "right": F.greatest(a, b), "top": F.least(c, d), "bottom": F.greatest(c, d)})
    whole = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    return boxes.filter(whole & ~F.col("kind").isin(*SKIPPED_KINDS) & (F.col("right") - F.col("left") >= 1) & (F.col("bottom") - F.col("top") >= 1)).select("page", "block_no", "kind", "left", "top", "right", "bottom")


def words_in_blocks(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """words, blocks: page and boxes. Each word whose centre lies in a block, with the first such block. The page is the join's key; the box is its residual."""
    box = blocks.select("page", "block_no", *(F.col(c).alias(f"b_{c}") for c in ("left", "top", "right", "bottom")))
    x, y = F.col("left") + F.col("right"), F.col("top") + F.col("bottom")
    inside = x.between(F.col("b_left") * 2, F.col("b_right") * 2) & y.between(F.col("b_top") * 2, F.col("b_bottom") * 2)
    return words.join(box, "page").filter(inside).groupBy("page", "word_no").agg(F.min("block_no").alias("block_no"))


def without_noise(words: DataFrame, claimed: DataFrame, blocks: DataFrame) -> DataFrame:
    """On pages with blocks, words outside of all blocks go if they are unsure; a word without confidence stays."""
    loose = words.join(claimed.select("page", "word_no"), ["page", "word_no"], "left_anti")
    noise = loose.filter(F.col("confidence") < NOISE_CONFIDENCE).join(blocks.select("page").distinct(), "page", "left_semi")
    return words.join(noise.select("page", "word_no"), ["page", "word_no"], "left_anti")


def stripes(blocks: DataFrame) -> DataFrame:
    """blocks: key, left, top, right, bottom, n_lines. A box for each line, of equal height."""
    step = (F.col("bottom") - F.col("top")) / F.col("n_lines")
    each = blocks.filter("n_lines > 0").withColumn("line_no", F.explode(F.sequence(F.lit(0), F.col("n_lines") - 1)))
    return each.withColumns({"line_top": F.col("top") + F.col("line_no") * step, "line_bottom": F.col("top") + (F.col("line_no") + 1) * step})


def spread_words(words: DataFrame, keys: list[str], order: str, left: Column, right: Column) -> DataFrame:
    """words: keys, order, word. Each word's share of its line's box, by its length: a prefix sum."""
    line = W.partitionBy(*keys)
    size = F.length("word") + 1
    before = F.coalesce(F.sum(size).over(line.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    unit = (right - left) / F.greatest(F.lit(1), F.sum(size).over(line) - 1)
    start = left + before * unit
    return words.withColumns({"word_left": start, "word_right": F.greatest(F.least(right, start + F.length("word") * unit), start + 0.5)})


def line_pitch(boxes: DataFrame, key: str) -> DataFrame:
    """boxes: key, top, bottom. The usual step from line to line: the upper median of the steps, within one and two line heights; without steps 1.6 heights."""
    step = F.lead("top").over(W.partitionBy(key).orderBy("top")) - F.col("top")
    grouped = boxes.withColumn("__step", step).groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("__step") > 0, F.col("__step")))).alias("s"), F.array_sort(F.collect_list(F.col("bottom") - F.col("top"))).alias("h"))
    middle = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    height = middle(F.col("h"))
    return grouped.select(key, F.when(F.size("s") == 0, height * 1.6).otherwise(F.greatest(height, F.least(middle(F.col("s")), height * 2))).cast("double").alias("pitch"))


def ink_coverage(histogram: DataFrame, key: str) -> DataFrame:
    """histogram: key, value, n. The share of pixels well darker than the paper: its grey is the lower median, white where that is dark."""
    of_key = W.partitionBy(key)
    running = F.sum("n").over(of_key.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(of_key)
    marked = histogram.withColumns({"__half": F.when(running * 2 >= total, F.col("value")), "__total": total})
    paper = marked.withColumn("__paper", F.min("__half").over(of_key))
    grey = F.when(F.col("__paper") < DARK_PAPER, F.lit(255)).otherwise(F.col("__paper"))
    dark = F.sum(F.when(F.col("value") < F.greatest(F.lit(0), grey - INK_MARGIN), F.col("n")).otherwise(0))
    return paper.groupBy(key).agg(dark.alias("dark"), F.max("__total").alias("total"))


def split_runs(words: DataFrame, keys: list[str], order: str, parts: Column) -> DataFrame:
    """words: keys, order, word. Adds bucket: ``parts`` runs of about the same length, in order."""
    size, of_key = F.length("word") + 1, W.partitionBy(*keys)
    done = F.coalesce(F.sum(size).over(of_key.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return words.withColumn("bucket", F.least(parts - 1, F.floor(done * parts / F.sum(size).over(of_key))).cast("int"))


def vote_winners(votes: DataFrame) -> DataFrame:
    """votes: page, word, line, place (one row per letter, or per run of n letters from a place on). The line with most votes for each word, the first voted for among equals."""
    n = F.sum("n") if "n" in votes.columns else F.count("*")
    counted = votes.groupBy("page", "word", "line").agg(n.alias("n"), F.min("place").alias("first"))
    best = F.row_number().over(W.partitionBy("page", "word").orderBy(F.col("n").desc(), "first"))
    return counted.withColumn("__r", best).filter("__r = 1").select("page", "word", "line", "n")


def never_back(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """A line number never lower than one before it."""
    return lines.withColumn(line, F.max(line).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def edge_runs(flags: DataFrame, keys: list[str], order: str, hit: str) -> DataFrame:
    """How many rows stand before a group's first hit (all if it has none) and after its last."""
    n = F.count("*")
    first, last = F.min(F.when(F.col(hit), F.col(order))), F.max(F.when(F.col(hit), F.col(order)))
    return flags.groupBy(*keys).agg(F.coalesce(first, n).cast("long").alias("lead"), F.coalesce(n - 1 - last, F.lit(0)).cast("long").alias("trail"))


def union_boxes(boxes: DataFrame, key: str) -> DataFrame:
    return boxes.groupBy(key).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def within_limit(rows: DataFrame, keys: list[str], order: str, size: str, most: int) -> DataFrame:
    """Adds fits: whether the sizes up to here stay within the limit."""
    return rows.withColumn("fits", F.sum(size).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) <= most)
