"""All links between items that share a bucket of a locality-sensitive hash, tile by tile.

Only items of one bucket are compared, and a pair only in the first band in which it shares a bucket, so the work grows with the buckets and
not with what chains of buckets connect. Buckets with the same items as one of an earlier band have nothing to add and are left out. A bucket
of n items is cut into blocks of about BLOCK items or BLOCK_BYTES bytes, dealt out by a hash, and each pair of blocks is a tile of its own: a bucket
of any size goes to many tasks, and what a task holds is bounded (by a single text where one is larger). Pairs never leave their tile: it gives, per item, the
links found there and a representative of what it is linked with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import cut, give_back, let_workers_import, shuffle_partitions
from pagewright.llm.components import components

#: (payloads of the rows, the band, rows of the first block, rows of the second; None within one block) -> arrays of linked row numbers. It gives only pairs that
#: share the band's bucket and none of an earlier band.
Linker = Callable[[pa.Table, int, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]
BLOCK = 384
BLOCK_BYTES = 4 << 20
#: What places a row in its tile.
TILE = ("key", "low", "high", "band", "blk")


def members(keys: DataFrame) -> DataFrame:
    """keys: item long, band int, key long (a bucket of that band), size of the item in bytes. TILE and item, for each tile that an item is in."""
    whole = F.bit_xor(F.xxhash64("item"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("bytes"), F.min("item").alias("least"), F.max("item").alias("most"), whole.alias("whole"), F.min("band").alias("band"))
    first = buckets.filter("least <> most").groupBy("n", "least", "most", "whole").agg(F.min(F.struct("band", "key", "bytes")).alias("first"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("first.bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    inside = keys.select("item", "band", "key").join(first.select(F.col("first.key").alias("key"), blocks.alias("g")), "key")
    placed = inside.withColumn("blk", F.pmod(F.xxhash64("item", "key"), F.col("g")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.select("key", F.least("blk", "other").alias("low"), F.greatest("blk", "other").alias("high"), "band", "blk", "item")


def all_pairs(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if second is None:
        i, j = np.triu_indices(len(first), 1)
        return first[i], first[j]
    return np.repeat(first, len(second)), np.tile(second, len(first))


def groups_of(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first columns, over batches of rows sorted by them. A run is held in memory."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = last is None or any(k[0] != x for k, x in zip(keys, last, strict=True))
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        if cuts[0] > 0 or not new[0]:
            held.append(batch.slice(0, cuts[0]))
        for at, end in zip(cuts, cuts[1:]):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(at, end - at)]
        last = [k[-1] for k in keys]
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row number that each row is connected with."""
    root = np.arange(n)
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        differ = low != high
        if not differ.any():
            break
        left, right, low, high = left[differ], right[differ], low[differ], high[differ]
        np.minimum.at(root, high, low)
        while (deeper := root[root] != root).any():
            root[deeper] = root[root[deeper]]
    return root


def _once(tile: pa.Table) -> pa.Table:
    """Without rows that repeat an item."""
    items = tile.column(5).to_pylist()
    if len(set(items)) == len(items):
        return tile
    first = {ids: i for i, ids in reversed([*enumerate(zip(items, tile.column(6).to_pylist(), strict=True))])}
    return tile if len(first) == len(items) else tile.take(pa.array(sorted(first.values())))


def _linked(link: Linker, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Each tile that has links, with their rows. Columns: TILE, item, item2, and the payload."""
    for tile in groups_of(batches, 3):
        tile = _once(tile)
        low, high, band = (tile.column(i)[0].as_py() for i in (1, 2, 3))
        blk = tile.column(4).to_numpy()
        first = np.flatnonzero(blk == low)
        left, right = link(tile, band, first, None if low == high else np.flatnonzero(blk == high))
        if len(left):
            yield tile, left, right
    give_back()


def _tiles(link: Linker, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload: copies first. Out: item, item2, links, hub for what has a link."""
    for tile, left, right in _linked(link, batches):
        item, item2, copies = (tile.column(i).to_numpy() for i in (5, 6, 7))
        n = tile.num_rows
        links = (np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)).astype(np.int64)
        some, hub = links > 0, item[local_roots(n, left, right)]
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (item, item2, links, hub)], names=["item", "item2", "links", "hub"])


def _candidates(link: Linker, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TILE, item, item2 of the rows that are in a pair."""
    for tile, left, right in _linked(link, batches):
        for batch in tile.select(range(7)).take(pa.array(np.union1d(left, right))).to_batches():
            yield batch


def _by_tile(rows: DataFrame, payload: list[str]) -> DataFrame:
    spark = rows.sparkSession
    let_workers_import(spark)
    dealt = rows.select(*TILE, "item", "item2", *payload).repartition(shuffle_partitions(spark), *TILE[:3])
    return dealt.sortWithinPartitions(*TILE[:3])


def candidates(rows: DataFrame, payload: list[str], link: Linker) -> DataFrame:
    """rows: TILE, item, item2 (two longs that identify an item), and the payload's columns. TILE, item, item2 of those that a link holds for."""
    return _by_tile(rows, payload).mapInArrow(lambda batches: _candidates(link, batches), "key long, low int, high int, band int, blk int, item long, item2 long")


def link_rows(rows: DataFrame, payload: list[str], link: Linker) -> DataFrame:
    """rows: as for ``candidates``, with copies, the number of equal rows that an item stands for.

    Gives (item, item2, links, root) for what has a link: links counts the copies of all items linked directly; root is the same for all items that
    links connect. Components know an item by its first long."""
    found = cut(_by_tile(rows, ["copies", *payload]).mapInArrow(lambda batches: _tiles(link, batches), "item long, item2 long, links long, hub long"))
    roots = components(found.select(F.col("item").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("item"), "root")
    return found.groupBy("item", "item2").agg(F.sum("links").alias("links")).join(roots, "item", "left").select("item", "item2", "links", F.coalesce("root", "item").alias("root"))
