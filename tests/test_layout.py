"""The neighbour layout: what is near stays near, and parts that have nothing in common lie apart."""

from __future__ import annotations

import numpy as np

from pagemill.operators import layout


def trustworthiness(high, low, k):
    """One, less a penalty for every point among a point's k nearest on the plane that is not among its k nearest in space."""
    unit = high / np.linalg.norm(high, axis=1, keepdims=True)
    n, penalty = len(high), 0
    far, near = 1 - unit @ unit.T, np.linalg.norm(low[:, None] - low[None], axis=2)
    for i in range(n):
        rank = {j: r for r, j in enumerate([j for j in np.argsort(far[i], kind="stable") if j != i], 1)}
        penalty += sum(max(0, rank[j] - k) for j in [j for j in np.argsort(near[i], kind="stable") if j != i][:k])
    return 1 - penalty * 2 / (n * k * (2 * n - 3 * k - 1))


def laid_out(spark, m, **options):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>").repartition(3)
    found = {r["id"]: r["coords"] for r in layout.neighbour_layout(df, **options).collect()}
    assert sorted(found) == list(range(len(m)))
    return np.array([found[i] for i in range(len(m))])


def test_a_curled_line_keeps_its_neighbours(spark):
    rng = np.random.default_rng(3)
    t = np.linspace(0, 1, 120)
    m = np.stack([f(w * np.pi * t) for w in (1, 2, 3) for f in (np.cos, np.sin)], axis=1) + rng.normal(size=(120, 6)) * 0.01
    low = laid_out(spark, m, k=6, steps=12)
    assert low.shape == (120, 2) and np.isfinite(low).all()
    assert trustworthiness(m, low, 6) > 0.95
    # along the line the slowest function goes one way
    assert abs(np.corrcoef(np.argsort(np.argsort(low[:, 0])), np.arange(120))[0, 1]) > 0.9


def test_groups_lie_apart(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(5)[:3] * 4
    label = np.arange(60) % 3
    m = centres[label] + rng.normal(size=(60, 5)) * 0.15
    low = laid_out(spark, m, k=5, steps=6)
    for g in range(3):
        own, other = low[label == g], low[label != g]
        within = np.linalg.norm(own - own.mean(axis=0), axis=1).max()
        assert np.linalg.norm(other - own.mean(axis=0), axis=1).min() > 3 * within


def test_few_points(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert layout.neighbour_layout(empty).count() == 0
    graph = layout.neighbour_graph(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<double>"), 1)
    pairs = {(r["a"], r["b"]) for r in graph.collect()}
    assert {(b, a) for a, b in pairs} == pairs and (1, 3) in pairs and (2, 3) in pairs
