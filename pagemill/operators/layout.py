"""Points on a plane that keep near what is near: a graph of nearest neighbours, and the slowest changing functions on it.

The graph joins every vector to its nearest ones (in both directions). A function on the points that changes as little as it
can along the edges is an eigenvector of the graph's walk matrix; the first is constant, the next ones are the coordinates.
They are found by power iteration with a few columns at once: in each step every point takes half of its own values and
half of its neighbours' mean, a join and a sum over the edges; from time to time the columns are made orthogonal again,
for which only their products, summed over all points, come to the driver. The columns begin as principal components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, written
from . import vector_index
from .vectors import plane

#: Neighbours of a point, columns that are iterated, steps, steps in one job, and steps between two orthogonalisations.
NEIGHBOURS, COLUMNS, STEPS, IN_ONE_JOB = 10, 4, 24, 3


def neighbour_graph(vectors: DataFrame, k: int = NEIGHBOURS, probes: int | None = None) -> DataFrame:
    """vectors (id, v) -> edges (a, b, w), each in both directions: the k nearest of each vector, itself left out.

    w is 1 - distance / 2, so between 0 and 1, and never 0. The nearest are found through an index of all vectors, exactly,
    or in `probes` lists. Ids must not repeat.
    """
    path = scratch_path(vectors.sparkSession, "layout-index")
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").alias("vector"))
    vector_index.build_index(rows, path)
    hits = vector_index.search(rows.withColumnRenamed("id", "qid"), path, k + 1, probes).where("qid <> id")
    near = hits.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.greatest(1 - F.col("distance") / 2, F.lit(1e-6)).alias("w"))
    return written(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w")), "graph")


def _products(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sums over all rows of the products of columns: a few numbers."""
    sums = rows.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{a}_{b}") for a in left for b in right]).first()
    return np.array(list(sums), float).reshape(len(left), len(right))


def _combined(names: list[str], weights: np.ndarray) -> list[Column]:
    return [sum((F.col(n) * float(w) for n, w in zip(names, column, strict=True)), F.lit(0.0)) for column in weights.T]


def _orthogonal(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with columns that are orthogonal to each other and to `root` (the constant function), of length one.

    A column that the others make up becomes 0.
    """
    gram = _products(rows, ["root", *names], ["root", *names])
    away = -gram[0, 1:] / max(gram[0, 0], 1e-300)
    inner = gram[1:, 1:] + np.outer(away, gram[0, 1:])
    values, turns = np.linalg.eigh(inner)
    scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    weights = (turns * scale)[:, ::-1]
    return rows.select("id", "root", *[c.alias(n) for n, c in zip(names, _combined(["root", *names], np.vstack([away @ weights, weights])), strict=True)])


def _step(rows: DataFrame, walk: DataFrame, names: list[str]) -> DataFrame:
    """Half of each point's own values, half of what its neighbours give; walk (a, b, w) is the edges' share of both degrees."""
    theirs = rows.select(F.col("id").alias("b"), *names)
    given = walk.join(theirs, "b").groupBy("a").agg(*[F.sum(F.col("w") * F.col(n)).alias(f"g_{n}") for n in names])
    return rows.join(given, rows["id"] == given["a"]).select("id", "root", *[((F.col(n) + F.col(f"g_{n}")) / 2).alias(n) for n in names])


def neighbour_layout(vectors: DataFrame, dims: int = 2, k: int = NEIGHBOURS, steps: int = STEPS, probes: int | None = None) -> DataFrame:
    """vectors (id, v) -> (id, coords array<double>), `dims` coordinates for each vector that has a neighbour.

    Signs and, for equal eigenvalues, turns are free. Null vectors are left out; ids must not repeat. Parts of the graph
    without an edge between them lie apart. Lineage is cut by a table every few steps.
    """
    held = vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), "v")
    graph = neighbour_graph(held, k, probes)
    size = held.select(F.size("v").alias("n")).first()
    columns = min(max(COLUMNS, dims), size["n"] if size else dims)
    names = [f"x{i}" for i in range(columns)]
    degree = written(graph.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d")), "degrees")
    by = lambda c: degree.select(F.col("id").alias(c), F.col("d").alias(f"d_{c}"))
    walk = written(graph.join(by("a"), "a").join(by("b"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d_a") * F.col("d_b"))).alias("w")), "walk")
    if degree.isEmpty():
        return held.select("id", F.array(*[F.lit(0.0)] * dims).alias("coords")).limit(0)
    root = F.sqrt("d")
    start = plane(held, columns).join(degree, "id").select("id", root.alias("root"), *[(F.get("coords", F.lit(i)) * root).alias(n) for i, n in enumerate(names)])
    rows = written(_orthogonal(written(start, "start"), names), "points")
    for at in range(0, steps, IN_ONE_JOB):
        for _ in range(min(IN_ONE_JOB, steps - at)):
            rows = _step(rows, walk, names)
        rows = written(_orthogonal(written(rows, "moved"), names), "points")
    # turned to the eigenvectors within the columns' span, the slowest changing first
    moved = _step(rows, walk, names).select("id", *[F.col(n).alias(f"m_{n}") for n in names])
    both = written(rows.join(moved, "id"), "moved")
    change = _products(both, names, [f"m_{n}" for n in names])
    values, turns = np.linalg.eigh((change + change.T) / 2)
    coords = _combined(names, turns[:, np.argsort(-values)][:, :dims])
    return both.select("id", F.array(*[c / F.col("root") for c in coords]).alias("coords"))
