"""Near-duplicate embeddings by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised; each table cuts K Gaussian projections into steps of WIDTH and hashes the K step numbers with the label to
a key. Two unit vectors of cosine 0.98 lie 0.2 apart: one projection agrees with probability 0.80, K of them with 0.069, and a pair
is missed by all TABLES tables with probability 0.001, less for closer pairs. Vectors that share a key of a table are a bucket, in which
every pair is checked by its cosine in double precision and counts in the first table that it shares (tiles.py).

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, have no links and are their own
component. Equal vectors of one label are one item with a number of copies, so copies are linked without expanding pairs. Vectors of
different lengths have no common key and link with nothing of another length. Repeated ids: each row counts; equal ids get the same component only if
their vectors are linked. A null id is never the smallest of a component unless alone. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import cut, let_workers_import
from pagewright.llm.tiles import link_rows, members

K = 12
WIDTH = 0.8
TABLES = 96
COSINE = 0.98


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@cache
def _draws(seed: int, length: int, k: int, width: float, tables: int) -> tuple[np.ndarray, ...]:
    """Projections, shifts and factors of the tables for vectors of a length."""
    rng = np.random.default_rng([seed, length])
    normals, shifts = rng.standard_normal((length, tables * k)), rng.uniform(0, width, tables * k)
    return normals, shifts, rng.integers(1, 2**62, (tables, k)) * 2 + 1


def table_keys(x: np.ndarray, seed: int, k: int, width: float, tables: int) -> np.ndarray:
    """rows x tables, int32; all draws come from the seed and the vectors' length."""
    normals, shifts, odd = _draws(seed, x.shape[1], k, width, tables)
    steps = np.floor((_unit(x) @ normals + shifts) / width).astype(np.int64).reshape(len(x), tables, k)
    mixed = (steps * odd).sum(axis=2).astype(np.uint64)
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _key_batches(seed: int, k: int, width: float, tables: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the keys to rows with a vector as the first column."""
    for batch in batches:
        lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            part = batch.take(pa.array(np.flatnonzero(lengths == length)))
            for at in range(0, part.num_rows, 2048):
                some = part.slice(at, 2048)
                keys = table_keys(_matrix(some.column(0)).astype(np.float64), seed, k, width, tables)
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * tables, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=[*some.schema.names, "keys"])


def cosine_linker(cosine: float):
    """Payload: copies, label, vector, keys."""

    def link(tile: pa.Table, band: int, first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        tile = tile.combine_chunks()
        labels, vectors, keys = tile.column(8).to_numpy(), tile.column(9).chunk(0), _matrix(tile.column(10).chunk(0))
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for length in set(lengths.tolist()):
            own = np.flatnonzero(lengths == length)
            unit = np.zeros((len(lengths), length))
            unit[own] = _unit(_matrix(vectors if len(own) == len(lengths) else vectors.take(pa.array(own))).astype(np.float64))
            a = first[lengths[first] == length]
            b = a if second is None else second[lengths[second] == length]
            near = (unit[a] @ unit[b].T >= cosine) & (labels[a][:, None] == labels[b])
            i, j = np.nonzero(np.triu(near, 1) if second is None else near)
            i, j = a[i], b[j]
            new = keys[i, band] == keys[j, band]
            for at in range(0, len(i), 20_000):
                some = slice(at, at + 20_000)
                new[some] &= ~(keys[i[some], :band] == keys[j[some], :band]).any(axis=1)
            found.append((i[new], j[new]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    return link


def links(rows: DataFrame, cosine: float = COSINE, k: int = K, width: float = WIDTH, tables: int = TABLES, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    let_workers_import(rows.sparkSession)
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    marked = own.withColumn("usable", usable)
    kind = own.schema["vector"].dataType.elementType.simpleString()
    # adding 0 makes -0 and 0 the same vector
    good = marked.filter("usable").withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))
    named = good.withColumns({"item": F.xxhash64("label", "vector"), "item2": F.xxhash64(F.lit("second"), "label", "vector")})
    items = named.groupBy("vector", "item", "item2", "label").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    # written once: what a pair has met in is read from the keys, not made again
    items = cut(items.mapInArrow(lambda batches: _key_batches(seed, k, width, tables, batches), f"{schema}, keys array<int>"), "items")
    keys = items.select("item", "label", F.lit(1).alias("size"), F.posexplode("keys").alias("band", "step")).select("item", "size", "band", F.xxhash64("band", "label", "step").alias("key"))
    rows = members(keys).join(items.drop("least"), "item")
    found = link_rows(rows, ["label", "vector", "keys"], cosine_linker(cosine))
    whole = items.select("item", "item2", "copies", "least").join(found, ["item", "item2"], "left")
    rooted = whole.select("item", "item2", "least", F.coalesce("root", "item").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    parts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_item = rooted.join(parts, "root").select("item", "item2", "n_links", "component_id")
    linked = named.select("vec_id", "item", "item2").join(by_item, ["item", "item2"]).select("vec_id", "n_links", "component_id")
    alone = marked.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
