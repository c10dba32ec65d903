"""A vector index on disk: inverted lists around centroids, searched exactly or in the nearest lists only.

Centroids are fitted on a bounded sample; every vector is stored in the list of its nearest centroid, with its distance to
it (radius). All vectors have length one here, so that cosine distance is half the square of the Euclidean distance, for
which the triangle inequality holds: no vector of a list is nearer to a query than the query's distance to the centroid
less the list's largest radius (or the smallest radius less that distance, for a query near the centroid).

A search first looks into the nearest lists, as many as hold n vectors. The n-th best distance found there bounds the
second look: lists whose bound lies beyond it cannot hold anything better, all others are read. The result is exact; only
the number of lists that are read depends on the centroids. Lists are folders, so lists that no query wants are not read.
Where many lists stay possible, a copy of a query for each would outgrow the input by far, so the second look sends copies
to bundles, lists in a row that hold about VECTOR_BLOCK vectors together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import FETCH_LIMIT, QUERY_BLOCK, VECTOR_BLOCK, blocks, nearest_in

#: About how many vectors the centroids are fitted on, and how many lists there are at most.
SAMPLE_ROWS, MAX_LISTS = 20_000, 4_096
#: The list of vectors of length zero, which have no direction: their distance to every query is 1.
NO_DIRECTION = -1
#: Room for rounding in the bounds.
ROOM = 1e-6


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The vectors of a batch, at length one; those of length zero stay zero."""
    m = np.asarray(column.flatten(), np.float64).reshape(rows, -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _to_centroids(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (m * m).sum(axis=1)[:, None] - 2 * m @ centroids.T + (centroids * centroids).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def fitted(vectors: DataFrame, lists: int, sample: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """Centroids (at most `lists`) of a sample of about `sample` vectors (id, vector), drawn by a hash of the id."""
    share = sample / max(vectors.count(), 1)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    some = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1e6 < share).withColumn("length", length).where("length > 0")
    some = written(some.select(F.transform("vector", lambda x: x.cast("double") / F.col("length")).alias("v")), "sample").select(array_to_vector("v").alias("features"))
    if some.isEmpty():
        return np.zeros((0, 0))
    return np.array(KMeans(k=max(lists, 2), seed=seed, maxIter=8).fit(some).clusterCenters())


def build_index(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE_ROWS) -> None:
    """Writes an index of vectors (id, vector) to path: folders of lists, and a table of the lists.

    lists: their number, by default the square root of that of the vectors, MAX_LISTS at most. Null vectors are left out;
    all others are indexed, equal ids and repeated rows too. A list with a large share of all vectors is written by as
    many tasks as its size asks for.
    """
    spark = vectors.sparkSession
    held = vectors.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    lists = min(lists or int(held.count() ** 0.5), MAX_LISTS)
    centroids = fitted(held, lists, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1), b.num_rows)
            if len(centroids):
                far = _to_centroids(m, centroids)
                near = far.argmin(axis=1)
                radius = far[np.arange(len(m)), near]
            else:
                near, radius = np.zeros(len(m), np.int64), np.zeros(len(m))
            blank = ~m.any(axis=1)
            near[blank], radius[blank] = NO_DIRECTION, 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(radius)], names=["id", "vector", "list", "radius"])

    placed = held.mapInArrow(run, "id long, vector array<double>, list int, radius double")
    ordered = placed.repartitionByRange("list", "radius", "id").sortWithinPartitions("list", "radius", "id")
    ordered.write.partitionBy("list").mode("overwrite").parquet(f"{path}/rows")
    stored = rows_of(spark, path)
    sizes = stored.groupBy("list").agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))
    places = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>")
    sizes.join(places, "list", "left").write.mode("overwrite").parquet(f"{path}/lists")


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """All vectors of an index (id, vector, radius, list)."""
    return spark.read.schema("id long, vector array<double>, radius double, list int").parquet(f"{path}/rows")


class Lists:
    """The table of an index's lists: one row each, MAX_LISTS and one at most."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.schema("list int, n long, least double, most double, centroid array<double>").parquet(f"{path}/lists").orderBy("list").collect()
        own = [r for r in rows if r["list"] != NO_DIRECTION]
        self.blank = sum(r["n"] for r in rows if r["list"] == NO_DIRECTION)
        self.numbers = np.array([r["list"] for r in own], np.int32)
        self.n, self.least, self.most = (np.array([r[c] for r in own], float) for c in ("n", "least", "most"))
        self.centroids = np.array([r["centroid"] for r in own], float).reshape(len(own), -1 if own else 0)
        #: of each list, and of the one of vectors without direction (last), the bundle it is in
        self.bundles = np.append((np.cumsum(self.n) - self.n) // VECTOR_BLOCK, NO_DIRECTION).astype(np.int32)

    def first(self, m: np.ndarray, n: int, probes: int | None) -> list[np.ndarray]:
        """Of each query the places of the lists to look into first: the nearest, as many as hold n vectors, or `probes`."""
        order = np.argsort(_to_centroids(m, self.centroids), axis=1, kind="stable") if len(self.n) else np.zeros((len(m), 0), int)
        if probes is not None:
            return list(order[:, :probes])
        upto = np.cumsum(self.n[order], axis=1)
        return [o[: int(np.searchsorted(u, n)) + 1] for o, u in zip(order, upto, strict=True)]

    def nearest_possible(self, m: np.ndarray) -> np.ndarray:
        """(queries, lists): a bound below the cosine distances of the list's vectors to a query; 0 for one without direction."""
        if not len(self.n):
            return np.zeros((len(m), 0))
        far = _to_centroids(m, self.centroids)
        gap = np.maximum(np.maximum(far - self.most, self.least - far) - ROOM, 0)
        return np.where(m.any(axis=1, keepdims=True), gap * gap / 2, 0)


def _asked(queries: DataFrame, wanted, by: str = "list") -> DataFrame:
    """queries (qid, vector, ...) -> (qid, vector, by) for each list or bundle that wanted(batch, matrix) names for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                found = wanted(part, _matrix(part.column(1), part.num_rows))
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(found).astype(np.int32))], names=["qid", "vector", by])

    return queries.mapInArrow(run, f"qid long, vector array<double>, {by} int")


def _met(spark: SparkSession, path: str, asked: DataFrame, bundles: dict[int, int] | None = None) -> DataFrame:
    """Blocks of queries and vectors of the same list, or of the same bundle (bundles: list -> bundle). Only folders of lists
    that are asked for are read.

    Copies of one query take little room on disk and much in memory, so Spark would take a large table of them for one that
    can be broadcast: the hint has both sides shuffled, whatever their files' size.
    """
    by = "list" if bundles is None else "bundle"
    wanted = {r[by] for r in asked.select(by).distinct().collect()}  # MAX_LISTS and one at most
    places = [(k, b) for k, b in (bundles or {k: k for k in wanted}).items() if b in wanted]
    held = rows_of(spark, path).where(F.col("list").isin([k for k, _ in places]))
    if bundles is not None:
        held = held.join(spark.createDataFrame(places, "list int, bundle int"), "list")
    met = blocks(held.select("id", "vector", by), VECTOR_BLOCK, ("ids", "v"), by, in_order=bundles is None)
    return met.join(blocks(asked.select("qid", "vector", by), QUERY_BLOCK, ("qids", "q"), by).hint("merge"), by)


def search(queries: DataFrame, path: str, n: int = FETCH_LIMIT, probes: int | None = None) -> DataFrame:
    """queries (qid, vector) -> (qid, id, distance), the n nearest vectors of an index, as retrieval.top_n has them.

    Exact, unless probes is given: then only that many of the nearest lists are looked into. Equal distances in the order of
    id. Queries without a vector are left out. An index or a table of queries without rows gives none.
    """
    spark = queries.sparkSession
    lists = Lists(spark, path)
    rows = written(queries.where("vector is not null").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")), "queries")
    blank = [NO_DIRECTION] * (lists.blank > 0)

    def at_first(batch: pa.RecordBatch, m: np.ndarray) -> list[np.ndarray]:
        return [np.append(lists.numbers[x], blank) for x in lists.first(m, n, probes)]

    near = nearest_in(_met(spark, path, written(_asked(rows, at_first), "asked")), n)
    if probes is not None:
        return near
    near = written(near, "near")
    reached = near.groupBy("qid").agg(F.count("*").alias("found"), F.max("distance").alias("far"))
    bound = F.when(F.col("found") >= n, F.col("far")).otherwise(F.lit(3.0))
    left = rows.join(reached, "qid", "left").select("qid", "vector", F.coalesce(bound, F.lit(3.0)).alias("bound"))

    def at_last(batch: pa.RecordBatch, m: np.ndarray) -> list[np.ndarray]:
        """The bundles to look into: none, or those of all lists that are possible and of those looked into at first."""
        possible = lists.nearest_possible(m) <= np.asarray(batch.column(2))[:, None] + ROOM
        found = []
        for p, x in zip(possible, lists.first(m, n, None), strict=True):
            seen = np.zeros(len(p), bool)
            seen[x] = True
            found.append(np.unique(np.append(lists.bundles[:-1][p | seen], blank)) if (p & ~seen).any() else np.zeros(0, np.int32))
        return found

    asked = written(_asked(left, at_last, "bundle"), "asked")
    more = nearest_in(_met(spark, path, asked, dict(zip([*lists.numbers.tolist(), NO_DIRECTION], lists.bundles.tolist(), strict=True))), n)
    # a query that looks again meets once more what it met at first
    return near.join(asked.select("qid").distinct(), "qid", "left_anti").unionByName(more)
