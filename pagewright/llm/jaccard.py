"""Similarity join of documents by the Jaccard similarity of their word n-grams, with Bayesian pruning of candidates.

Words are maximal runs of bytes other than space and U+0009..U+000D; a shingle is N consecutive words. MinHash values of 16 bits, cut into bands,
give buckets (tiles.py). In a tile, the MinHash values of each pair are compared CHUNK at a time; with a uniform prior, a pair
is dropped as soon as the posterior probability that its similarity reaches THRESHOLD falls below TOLERANCE. First only the values are dealt out to
the tiles; texts go to the tiles where a pair was left, and there such pairs are verified on the whole shingle sets, in integers.

A pair at similarity 0.8 is missed by all 30 bands of 5 values with probability 7e-6, less for closer pairs. Shingles are 64-bit hashes of their words.

Defined results: a text with one to four words has one shingle, all its words. A text without words (null, empty, white space) links with
nothing. Equal texts are one item with a number of copies, so copies are linked without expanding pairs; an item is identified by 128 bits
of hash. Repeated rows are copies. A null id is the smallest of a group only if all its ids are null. An empty table gives an empty result. Extra columns
are ignored by ``links`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import cut, give_back, hidden, let_workers_import, number_of, numbered
from pagewright.llm.pieces import mixed, slices, text_buffer, word_hashes
from pagewright.llm.tiles import TILE, all_pairs, candidates, link_rows, members

N = 5
THRESHOLD = (4, 5)
BANDS, PER_BAND = 30, 5
CHUNK = 25
TOLERANCE = 1e-6
_rng = np.random.default_rng(41)
_FACTORS = _rng.integers(0, 2**64, 2 * N, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(0, 2**32, BANDS * PER_BAND, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * PER_BAND, dtype=np.uint32)
_is_space = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_ITEM, _ITEM2, _TEXT = (hidden(x) for x in ("item", "item2", "text"))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each text in order, repeated ones too, and how many come before each text (and in all)."""
    n = int(offsets[-1])
    space = np.ones(n + 2, bool)
    space[1:-1] = _is_space[data[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space[1:-1] & (space[:-2] | edge[:-1]))
    ends = np.flatnonzero(~space[1:-1] & (space[2:] | edge[1:])) + 1
    words = word_hashes(data[:n], starts, ends)
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    many = np.maximum(counts - N + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], many) + np.arange(out_bounds[-1])
    length = np.repeat(np.minimum(counts, N), many)
    padded = np.concatenate([words, np.zeros(N, np.uint64)])
    total = _FACTORS[N + length - 1].copy() if len(first) else np.zeros(0, np.uint64)
    for k in range(N):
        part = padded[first + k] * _FACTORS[k]
        total += part if not len(length) or length.min() == N else np.where(k < length, part, np.uint64(0))
    return mixed(total), out_bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each: one row per function, one column per text; every text must have a shingle."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(_A), len(bounds) - 1), np.uint32)
    if len(bounds) > 1:
        room = np.empty_like(x)
        for k in range(len(_A)):
            np.multiply(x, _A[k], out=room)
            np.add(room, _B[k], out=room)
            np.minimum.reduceat(room, bounds[:-1], out=out[k])
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, item, item2, id -> item, item2, id, size, values (none for a text without words)"""
    for batch in batches:
        done = 0
        for part in slices(batch.column(0)):
            data, offsets = text_buffer(part)
            hashes, bounds = shingles(data, offsets)
            some = np.flatnonzero(np.diff(bounds))
            values = np.ascontiguousarray(signatures(hashes, np.append(bounds[some], bounds[-1])).T)
            signed: list[bytes] = [b""] * len(part)
            for row, own in zip(some.tolist(), values, strict=True):
                signed[row] = own.tobytes()
            named = [batch.column(i).slice(done, len(part)) for i in (1, 2, 3)]
            done += len(part)
            sizes = np.minimum(np.diff(offsets), 2**31 - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*named, pa.array(sizes), pa.array(signed, pa.binary())], names=["item", "item2", "doc_id", "size", "values"])
    give_back()


@cache
def least_matches(n: int, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least m of n equal values at which the similarity may still reach the threshold.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1); that it lies above t has the probability
    of at most m successes in n + 1 trials of chance t."""
    t, below = threshold[0] / threshold[1], 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def likely_pairs(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of columns that no comparison dropped."""
    matches = np.zeros(len(a), np.int32)
    for at in range(0, len(values), CHUNK):
        if not len(a):
            break
        some = values[at : at + CHUNK]
        matches += (some[:, a] == some[:, b]).sum(axis=0, dtype=np.int32)
        keep = matches >= least_matches(at + len(some))
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets."""
    if len(a) <= 32:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    rows = np.unique(np.concatenate([a, b]))
    number = np.zeros(len(sets), np.int64)
    number[rows] = np.arange(len(rows))
    flat = np.concatenate([sets[i] for i in rows.tolist()])
    owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows.tolist()])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):  # a bounded part of the columns at a time
        low, high = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(rows), 4096), np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        out += part @ part.T
    return out[number[a], number[b]].astype(np.int64)


def first_met(values: np.ndarray, band: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs (a, b) share the band's values, and all values of no earlier band."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 50_000):
        x, y = a[at : at + 50_000], b[at : at + 50_000]
        grouped = values[: (band + 1) * PER_BAND].reshape(band + 1, PER_BAND, -1)
        same = (grouped[:, :, x] == grouped[:, :, y]).all(axis=1)
        out[at : at + 50_000] = same[band] & ~same[:band].any(axis=0)
    return out


def _met(values: np.ndarray, band: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = likely_pairs(values, a, b)
    new = first_met(values, band, a, b)
    return a[new], b[new]


def prune(tile: pa.Table, band: int, first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs left by their MinHash values alone. Payload: values."""
    flat = np.frombuffer(b"".join(tile.column(7).to_pylist()), np.uint16)
    return _met(np.ascontiguousarray(flat.reshape(tile.num_rows, -1).T), band, *all_pairs(first, second))


def verify(tile: pa.Table, band: int, first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that reach the threshold. Payload: copies, text."""
    hashes, bounds = shingles(*text_buffer(tile.column(8).combine_chunks()))
    values = signatures(hashes, bounds)  # all have shingles, or they would have no candidates
    a, b = _met(values, band, *all_pairs(first, second))
    sets: list[np.ndarray] = [np.unique(hashes[x:y]) for x, y in zip(bounds.tolist(), bounds.tolist()[1:])]
    many = np.array([len(x) for x in sets])
    # no pair of sets can be more alike than the smaller is large
    near = THRESHOLD[1] * np.minimum(many[a], many[b]) >= THRESHOLD[0] * np.maximum(many[a], many[b])
    a, b = a[near], b[near]
    common = _common(sets, a, b)
    near = common * THRESHOLD[1] >= THRESHOLD[0] * (many[a] + many[b] - common)
    return a[near], b[near]


def _identified(docs: DataFrame, text: str) -> DataFrame:
    own = docs.withColumn(_TEXT, F.coalesce(F.col(text), F.lit("")))
    return own.withColumns({_ITEM: F.xxhash64(_TEXT), _ITEM2: F.xxhash64(F.lit("second"), F.col(_TEXT))})


def _items(own: DataFrame, id_col: str) -> DataFrame:
    """Of documents with their item: items with copies, least id, links and root."""
    let_workers_import(own.sparkSession)
    base = own.select(F.col(_TEXT).alias("text"), F.col(_ITEM).alias("item"), F.col(_ITEM2).alias("item2"), F.col(id_col).alias("doc_id"))
    kind = base.schema["doc_id"].dataType.simpleString()
    signed = base.mapInArrow(_signature_batches, f"item long, item2 long, doc_id {kind}, size int, values binary")
    items = cut(signed.groupBy("item", "item2", "size", "values").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "items")
    width = 2 * PER_BAND
    of_band = lambda j: F.xxhash64(j, F.substr("values", j * width + 1, F.lit(width)))
    keys = items.filter(F.length("values") > 0).select("item", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), of_band)).alias("band", "key"))
    tiles = members(keys).join(items.select("item", "item2", "values"), "item")
    left = cut(candidates(tiles, ["values"], prune), "candidates")
    wanted = left.select("item", "item2").distinct().join(items.select("item", "item2", "copies", F.col("least").alias("rep")), ["item", "item2"])
    # one document of each item; by its id, too, so that copies of one text don't meet in one task
    texts = base.withColumnsRenamed({"item": "i", "item2": "i2"}).join(wanted, (F.col("i") == F.col("item")) & (F.col("i2") == F.col("item2")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    rows = left.join(texts.select("item", "item2", "copies", "text"), ["item", "item2"]).select(*TILE, "item", "item2", "copies", "text")
    found = link_rows(rows, ["text"], verify)
    whole = items.join(found, ["item", "item2"], "left")
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return whole.select("item", "item2", "least", (F.length("values") == 0).alias("wordless"), F.coalesce("root", "item").alias("root"), links.alias("n_links"))


def _grouped(items: DataFrame) -> DataFrame:
    """item, item2, wordless, n_links, group_id: the least id of what links connect; and the item that stands for it."""
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "item", "item2")).alias("first")
    groups = items.groupBy("root").agg(first).select("root", F.col("first.least").alias("group_id"), F.col("first.item").alias("top"), F.col("first.item2").alias("top2"))
    return items.join(groups, "root")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_links (other documents linked directly), group_id (the least id that links reach), kept."""
    own = _identified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    known = _grouped(_items(own, "doc_id"))
    rows = own.select("doc_id", F.col(_ITEM).alias("item"), F.col(_ITEM2).alias("item2"))
    joined = rows.join(known, ["item", "item2"])
    alone = F.col("wordless")
    out = joined.select(
        "doc_id",
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, one of each group: that of the least id. Texts without words all stay."""
    rows, id_ = numbered(docs), number_of(docs, id_col)
    own = _identified(rows, number_of(docs, text_col))
    known = _grouped(_items(own, id_))
    tops = known.filter((F.col("item") == F.col("top")) & (F.col("item2") == F.col("top2")) & ~F.col("wordless")).select("item", "item2", "least")
    # by the id, too: copies of one text don't meet in one task
    kept = own.join(tops, (F.col(_ITEM) == F.col("item")) & (F.col(_ITEM2) == F.col("item2")) & F.col(id_).eqNullSafe(F.col("least"))).dropDuplicates([_ITEM, _ITEM2])
    wordless = own.filter(~F.col(_TEXT).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(rows.columns).unionByName(wordless.select(rows.columns)).toDF(*docs.columns)
