"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is target weight * all characters / its characters: the mean number of times that each of its documents is to
occur. Each document's number of copies inverts a Poisson distribution of that mean at a uniform number that a hash of seed and
document id gives, so a rerun gives the same mix. Documents are exploded by their copies and dealt out over the whole output by
another hash of seed, id and copy, and sorted by it within partitions: a global shuffle in which no source or copy group meets.
Rows of one id and copy number share a position.

The rates have one row per named source and one for all others ("*"), so their number is bounded by the parameter and they are
put into the plan as constants; the corpus' counts cover all rows.

Defined results: a null or empty text has length 0 and takes its source's rate; a null source belongs to "*"; a null id hashes
as the empty string. Rows with equal ids get equal numbers of copies. A named source without characters gets rate 0. An empty
table gives an empty mix. Extra columns are kept by ``mixed_documents``, whatever their names; ``mix`` adds ``copy`` and ``position``, in the place of input
columns of these names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import hidden, number_of, numbered, shuffle_partitions

#: The production mix: shares of all characters. "*" stands for all sources that aren't named.
WEIGHTS = {"src0": 0.2, "src1": 0.08, "src2": 0.08, "src3": 0.08, "*": 0.56}
MOST_SOURCES = 2000
#: Terms below this share of the largest one can't be told apart by a 52-bit number.
_LEAST_TERM = 2.0**-64
_COPIES, _KEY, _N = (hidden(x) for x in ("copies", "key", "n"))


def rates(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, source_col: str = "source", text_col: str = "text") -> dict[str, float]:
    """Mean repetitions by source, from the characters of all documents."""
    if len(weights) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} weights; group the sources")
    named = [x for x in weights if x != "*"]
    group = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit("*")) if named else F.lit("*")
    found = docs.groupBy(group.alias(_KEY)).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias(_N)).collect()  # at most len(weights) + 1 rows
    chars = {r[0]: r[1] or 0 for r in found}
    total, share = sum(chars.values()), sum(weights.values())
    return {s: (weights.get(s, 0.0) / share * total / chars[s] if chars.get(s) else 0.0) for s in {*weights, "*"}}


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def thresholds(mean: float) -> tuple[int, list[float]]:
    """(first, the distribution's function at first, first + 1 ...) over all k that a 52-bit number can tell apart: about 19 * sqrt(mean) of them.

    The terms are relative to the largest one, so that exp(-mean) doesn't vanish.
    """
    if mean <= 0:
        return 0, []
    mode = int(mean)
    below, above, term, k = [], [1.0], 1.0, mode
    while k > 0 and term > _LEAST_TERM:
        term *= k / mean
        k -= 1
        below.append(term)
    first, term, k = k, 1.0, mode
    while term > _LEAST_TERM:
        k += 1
        term *= mean / k
        above.append(term)
    terms = below[::-1] + above
    whole = math.fsum(terms)
    return first, [round(x / whole, 15) for x in accumulate(terms)]


def copies(by_source: Mapping[str, float], u: Column, source_col: str = "source") -> Column:
    """The least k whose distribution function lies above u: how many of the source's thresholds are at most u, with those left out below the first."""
    made = {s: thresholds(rate) for s, rate in by_source.items()}
    first = _by_source(made, lambda x: F.lit(x[0]), source_col)
    steps = _by_source(made, lambda x: F.from_json(F.lit(json.dumps(x[1])), "array<double>"), source_col)
    below = F.transform(F.array(u), lambda v: F.size(F.filter(steps, lambda t: t <= v)))  # so that u is evaluated once
    return F.get(below, 0) + first


def _by_source(by_source: Mapping[str, tuple[int, list[float]]], make: Callable[[tuple[int, list[float]]], Column], source_col: str) -> Column:
    found = None
    for source, own in sorted(by_source.items()):
        if source != "*":
            found = (F.when if found is None else found.when)(F.col(source_col) == source, make(own))
    rest = make(by_source.get("*", (0, [])))
    return rest if found is None else found.otherwise(rest)


def _placed(docs: DataFrame, weights: Mapping[str, float], seed: int, id_col: str, source_col: str, text_col: str, by_source: Mapping[str, float] | None) -> DataFrame:
    """The documents' columns by number, copy and position, shuffled."""
    by_source = by_source if by_source is not None else rates(docs, weights, source_col, text_col)
    rows, id_, source = numbered(docs), F.col(number_of(docs, id_col)), number_of(docs, source_col)
    many = rows.withColumn(_COPIES, copies(by_source, uniform(seed, id_), source)).filter(F.col(_COPIES) > 0)
    each = many.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(_COPIES) - 1))).drop(_COPIES)
    text = F.concat_ws(":", F.lit(str(seed + 1)), F.coalesce(id_.cast("string"), F.lit("")), F.col("copy").cast("string"))
    placed = each.withColumn("position", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))
    return placed.repartition(shuffle_partitions(docs.sparkSession), "position").sortWithinPartitions("position")


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", by_source: Mapping[str, float] | None = None) -> DataFrame:
    """The documents' columns, copy (from 0) and position (the hash that orders the output within each of its partitions)."""
    placed = _placed(docs, weights, seed, id_col, source_col, text_col, by_source)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("copy", "position")]
    return placed.select(*own, "copy", "position")


def mixed_documents(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", by_source: Mapping[str, float] | None = None) -> DataFrame:
    """The mix with the documents' columns only."""
    return _placed(docs, weights, seed, id_col, source_col, text_col, by_source).drop("copy", "position").toDF(*docs.columns)
