"""Hard negatives: brute force over all pairs, bounds, edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadgrid.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows):
    ok = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        ok.append((i, vec_id, [math.floor(256.0 * x) for x in v], label))
    place = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for i, a, v, label in ok:
        if a is None or a % 50:
            continue
        scored = [(max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), b, j, other) for j, b, w, other in ok if j != i]
        for p, b, _, _ in sorted((s for s in scored if s[3] == label), key=place)[:5]:
            inside = sorted((s for s in scored if s[3] != label and 50 * p <= 100 * s[0] <= 95 * p), key=place)[:3]
            out += [(a, b, k, s[1], p, s[0]) for k, s in enumerate(inside, 1)]
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])


def _clustered(n, seed=0, dim=8, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, [float(x) for x in np.float32(centres[i % 12] + spread * rng.normal(size=dim))], int(rng.integers(0, 10))) for i in range(n)]


def _check(spark, rows, **options):
    got = hn.mine(spark.createDataFrame(rows, VECTORS), **options).drop("positive_rank").collect()
    assert _sorted(map(tuple, got)) == _sorted(brute(rows))
    return got


@pytest.mark.parametrize("block, group", [(512, 4096), (3, 40)])
def test_equals_brute_force(spark, block, group):
    rows = _clustered(1500)
    got = _check(spark, rows, block=block, group=group)
    assert len(got) > 100


def test_ties_copies_and_lengths(spark):
    rows = [(i % 120 if i % 11 else None, [0.5, 0.25 * (i % 4)][:1 + (i % 5 > 0)], i % 3) for i in range(400)] + [(50, [], 1), (100, [0.0, 0.0, 9.0], 1), (150, [0.5, 0.25], 0)]
    _check(spark, rows, block=2, group=50)


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in (1e6 * (1 + i % 7), 3e5 - i, 1e14 if i % 90 == 50 else 1.0)], i % 4) for i in range(300)] + [(350, [1e300, 1.0], 0), (400, [-1e300], 0), (301, [1e300], 1), (303, [8e299], 0)]
    _check(spark, rows, block=3, group=60)


def test_edges(spark):
    rows = [(0, None, 1), (50, [1.0, None], 1), (100, [1.0, float("nan")], 1), (150, [float("inf"), 0.0], 1), (200, [1.0, 0.0], None), (250, [1.0, 0.0], 1), (251, [0.9, 0.1], 1),
            (252, [0.8, 0.1], 2), (300, [-1.0, 0.0], 3), (301, [1.0, 0.0], 3), (None, [0.7, 0.7], 1), (None, [0.6, 0.7], 4), (350, [0.0, 0.0], 5), (351, [0.0, 0.0], 6), (400, [1.0], 7)]
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("uid", "id", "vector", "score", "ab", "cg", "anchor", "positive", "rank"):
        df = df.withColumn(c, F.lit("x"))
    assert _sorted(map(tuple, hn.report(df).collect())) == _sorted(brute(rows))
    assert hn.report(spark.createDataFrame([], VECTORS)).collect() == []
    assert hn.report(spark.createDataFrame([(1, [1.0], 1)], VECTORS)).collect() == []


def test_tree_spans_and_bounds_save_work():
    rng = np.random.default_rng(3)
    m = np.floor(256 * rng.normal(size=(40, 6)))
    order, parent, edge = hn.spanning_tree(m)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(parent[i] < i for i in range(1, 40))
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    assert np.allclose(edge[1:], [d[order[i], order[parent[i]]] for i in range(1, 40)])
    # The total equals Kruskal's.
    group, total = list(range(40)), 0.0
    for w, i, j in sorted((d[i, j], i, j) for i in range(40) for j in range(i)):
        if group[i] != group[j]:
            total += w
            group = [group[j] if g == group[i] else g for g in group]
    assert math.isclose(total, edge.sum())
    centre = rng.normal(size=16)
    anchors = centre + 0.02 * rng.normal(size=(30, 16))
    rows = rng.normal(size=(2000, 16))
    order, parent, edge = hn.spanning_tree(hn._matrix(anchors, 16))
    a = pd.DataFrame({"vector": [anchors[i] for i in order], "uid": -1 - order, "label": 1, "pos": range(30), "parent": parent, "edge": edge})
    c = pd.DataFrame({"vector": list(rows), "uid": range(2000), "id": range(2000), "noid": False, "label": 1})
    seen = []
    walk = hn.Walk
    try:
        hn.Walk = lambda *x: seen.append(walk(*x)) or seen[-1]
        got = hn.nearest(a, c)
    finally:
        hn.Walk = walk
    assert len(got) == 150 and seen[0].scored < 0.2 * 30 * 2000
