import random

import numpy as np
import pyarrow as pa

from pagewright.llm import embed_dedup, tiles
from pagewright.llm.components import components


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, *edges[:5]], "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    want = union_find(nodes, edges)
    assert got.keys() == nodes
    groups = lambda of: sorted(sorted(n for n in nodes if of[n] == r) for r in set(of.values()))
    assert groups(got) == groups(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_joins_runs_over_batches():
    batches = [pa.RecordBatch.from_pydict({"a": a, "b": b}) for a, b in (([1, 1, 2], [1, 1, 1]), ([2, 2], [1, 2]), ([], []), ([2, 3], [2, 3]), ([3], [3]))]
    batches = [b if b.num_rows else batches[0].slice(0, 0) for b in batches]
    assert [t.num_rows for t in tiles.groups_of(iter(batches), 2)] == [2, 2, 2, 2]


def brute(rows):
    """Links of every pair by the definition."""
    good = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    edges = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= embed_dedup.COSINE]
    root = union_find(range(len(rows)), edges)
    least = {}
    for i, (v, *_) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], v), v)
    return sorted((v, sum(i in e for e in edges), least[root[i]], v == least[root[i]]) for i, (v, *_) in enumerate(rows))


def make_rows():
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        base = rng.standard_normal(16)
        for _ in range(9):
            rows.append((len(rows), (base + rng.standard_normal(16) * rng.choice([0.02, 0.08, 0.12])).tolist(), c % 3))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(4)] + [(1010, rows[5][1], None), (1011, None, 1), (1012, [0.0] * 16, 1), (1013, [float("nan")] * 16, 1), (1014, [1.0, None] + [0.0] * 14, 1), (1015, [1.0] * 8, 1), (1016, [], 1), (1017, [float("inf")] + [0.0] * 15, 1), (1018, [2 * x for x in rows[5][1]], rows[5][2])]
    return rows


def test_embedding_links_match_brute_force(spark):
    rows = make_rows()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, item string")
    assert sorted(map(tuple, embed_dedup.links(frame).collect())) == brute(rows)


def test_large_groups_are_cut_into_tiles(spark, monkeypatch):
    rows = make_rows()
    monkeypatch.setattr(tiles, "BLOCK", 2)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embed_dedup.links(frame).collect())) == brute(rows)


def test_no_embeddings(spark):
    assert embed_dedup.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
