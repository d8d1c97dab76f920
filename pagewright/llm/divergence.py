"""How far the sources of a language differ: exact distances between the term distributions of sources, and the terms that mark a source.

Plain relational, in DataFrame functions: matches of the term pattern are exploded and counted by language, source and term in one pass (with
partial aggregation), groups are crossed with the vocabulary of their language to fill in zeros, the dense table is joined with itself on language and
term, and distances are summed and ranked by windows.

A language's vocabulary are the terms that stand in at least ``min_docs`` of its documents, V in number. With n of a term in a group and N the sum of n over the
vocabulary, its share is p = 1 + floor(10^9 (n + 5) / (N + 5 V)), in whole numbers throughout: nothing depends on the order of sums.

Keys: a vocabulary meets its groups by language and a bucket of the term's hash, so that one language's terms are dealt out over all tasks; what follows is keyed by
term, and by pair of sources with partial sums. Every pair of sources of a language is in the result, so work grows with pairs times vocabulary.

Defined results: a null text, language or source is the empty string. Each row is a document of its own, repeated ones too. Documents without a
term still make their group occur. A language without vocabulary has pairs at distance 0 and no terms. An empty table gives no rows.
Columns beyond text, lang and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import cut, shuffle_partitions, text_or_empty

#: What stands between terms: all of ASCII but its letters. Terms are the longest runs of other characters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
TOP_TERMS = 50
_PRIOR = 5
_SCALE = 1_000_000_000


def lower_ascii(text: Column) -> Column:
    """Only A to Z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (documents with it), and rows with a null term that keep groups whose documents have none."""
    # the matches of the pattern by what lies between them: Spark copies the whole text for each match that regexp_extract_all gives
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), F.split(lower_ascii(text_or_empty()), BETWEEN).alias("terms"))
    # a document's terms, once with and once without repeats, so that one count serves both
    both = rows.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    each = both.select("lang", "source", "once", F.explode("terms").alias("term")).withColumn("term", F.nullif("term", F.lit("")))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("once") == 0).alias("n"), F.count_if(F.col("once") == 1).alias("n_docs"))


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n of the terms that enough documents of the language have."""
    terms = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return terms.where(F.col("n_docs") >= min_docs).drop("n_docs")


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (N + 5 V)), in decimals wide enough for any count."""
    return F.expr(f"1L + (({_SCALE}BD * cast({n} + {_PRIOR} as decimal(20, 0))) div cast({total} + {_PRIOR} * {terms} as decimal(20, 0)))")


def shares(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, p and q: each group's share of each term of its language's vocabulary, zeros included, and the language's own share."""
    buckets = shuffle_partitions(counts.sparkSession)
    kept = cut(vocabulary(counts, min_docs), "vocabulary")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    words = kept.join(langs, "lang").select("lang", "term", "terms", _share("n", "lang_total", "terms").alias("q"), F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    groups = counts.select("lang", "source").distinct()
    spread = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    found = counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n")
    totals = groups.join(found.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, "total")
    dense = words.join(spread, ["lang", "bucket"]).drop("bucket").join(found, ["lang", "source", "term"], "left").fillna(0, "n")
    return dense.join(totals, ["lang", "source"]).select("lang", "source", "term", "n", _share("n", "total", "terms").alias("p"), "q")


def pair_distances(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value: the sum of differences over the vocabulary."""
    a, b = (dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("source", "p"), ("item", "other")))
    half = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
    both = half.select("lang", F.explode(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("x")).select("lang", "x.*")
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    return pairs.join(both, ["lang", "source", "item"], "left").fillna(0, "value")


def marking_terms(dense: DataFrame) -> DataFrame:
    """lang, source, item (a term of the group that it has more of than its language), value: by how much."""
    return dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by distance (``pair``), and the top_terms most marking terms (``term``)."""
    counts = cut(term_counts(docs), "term-counts")
    dense = cut(shares(counts, min_docs), "shares")
    order = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_distances(dense, counts.select("lang", "source").distinct()).withColumn("rank", order)
    terms = marking_terms(dense).withColumn("rank", order).where(F.col("rank") <= top_terms)
    columns = ["item", F.col("value").cast("long").alias("value"), "rank"]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *columns).unionByName(terms.select("lang", "source", F.lit("term").alias("part"), *columns))
