"""Exact cosine retrieval: top N of each query, validity joins, scores, gates, distance cut, numbering.

The order of these steps is part of the result: the top N are taken before anything is filtered out, rows are ranked by
score, but cut by the distance of the row of the best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..functions.text import concept_tokens, short_penalty

FETCH_LIMIT, MAX_DISTANCE, DISTANCE_MARGIN = 300, 0.45, 0.15
#: Vectors, and queries, that meet as one matrix product.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512
#: Vectors of a block that nearest_in looks at at a time, and queries whose best rows it gives out at a time.
SLICE, GIVEN_QUERIES = 2048, 512
#: Queries whose best rows a task holds before it gives them out.
KEPT_QUERIES = 4096


def blocks(rows: DataFrame, size: int, names: tuple[str, str], by: str | None = None, in_order: bool = False) -> DataFrame:
    """(id, vector) rows as rows of `size` ids and their vectors end to end, without a shuffle.

    by: rows are (id, vector, by), and a block holds rows of one value only, which it has as a column. For that the rows are
    sorted by range, so that a value with a large share of all rows lies in as many partitions as its size asks for;
    in_order: they come with rows of one value together. Vectors of floats stay floats, which halves what is sent.
    """
    exact = "float" if rows.schema[1].dataType.elementType == FloatType() else "double"
    kind = None if by is None else rows.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = [0, b.num_rows]
            if by is not None:
                codes = b.column(2).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                for at in range(start, end, size):
                    part = b.slice(at, min(size, end - at))
                    flat = part.column(1).flatten().cast(exact)
                    columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)]
                    yield pa.RecordBatch.from_arrays(columns + ([] if by is None else [part.column(2).slice(0, 1)]), names=[*names, *([] if by is None else [by])])

    if by is not None and not in_order:
        first = rows.columns[0]
        rows = rows.repartitionByRange(by, first).sortWithinPartitions(by, first)
    return rows.mapInArrow(run, f"{names[0]} array<long>, {names[1]} array<{exact}>" + ("" if by is None else f", `{by}` {kind}"))


def distances(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, cosine distances, vector ids) of each pair of blocks; size: of so many of its vectors at a time."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for b in batches:
        for k in range(b.num_rows):
            qids, ids = (np.array(b.column(c)[k].as_py(), np.int64) for c in (0, 2))
            a, m = (unit(np.asarray(b.column(c)[k].values, np.float64).reshape(len(x), -1)) for c, x in ((1, qids), (3, ids)))
            step = size or max(len(ids), 1)
            for at in range(0, len(ids), step):
                far = a @ m[at : at + step].T
                yield qids, np.subtract(1, far, out=far), ids[at : at + step]


def nearest_in(pairs: DataFrame, n: int) -> DataFrame:
    """pairs (qids, q, ids, v) of blocks -> (qid, id, distance), the n nearest of each query among what it met.

    Distance is 1 - cosine; equal distances in the order of id. A task keeps n rows of each query, and a ranking over those
    gives the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query the best so far in this task, so that few rows leave it however many blocks it meets
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for part in batched(best.items(), GIVEN_QUERIES):
                sizes = [len(d) for _, (d, _) in part]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([q for q, _ in part], np.int64), sizes)), pa.array(np.concatenate([i for _, (_, i) in part])), pa.array(np.concatenate([d for _, (d, _) in part]))], names=["qid", "id", "distance"])

        for qids, far, ids in distances(batches, SLICE):
            if len(best) > KEPT_QUERIES:
                yield from given()
                best = {}
            for row, qid in enumerate(qids.tolist()):
                d, i = far[row], ids
                if qid in best:
                    d, i = np.concatenate((best[qid][0], d)), np.concatenate((best[qid][1], i))
                order = np.lexsort((i, d))[:n]
                best[qid] = d[order], i[order]
        if best:
            yield from given()

    near = pairs.select("qids", "q", "ids", "v").mapInArrow(run, "qid long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return near.withColumn("nearness", rank).where(F.col("nearness") <= n).drop("nearness")


def top_n(queries: DataFrame, vectors: DataFrame, n: int = FETCH_LIMIT, by: str | None = None) -> DataFrame:
    """queries (qid, vector), vectors (id, vector) of one length -> (qid, id, distance), the n nearest of each query.

    Queries and vectors meet in blocks, as matrix products (nearest_in). Null vectors are left out.

    by: a column of both; a query meets only vectors of its own value, before the n nearest are taken. Blocks then hold
    one value each and meet by an equi-join, in which adaptive execution can split a hot value. A query whose value is
    null is not restricted; a vector whose value is null is met by such queries only.
    """
    own = [] if by is None else [by]
    asked = queries.where("vector is not null").select(F.col("qid").cast("long"), "vector", *own)
    held = vectors.where("vector is not null").select(F.col("id").cast("long"), "vector", *own)
    free = asked if by is None else asked.where(F.col(by).isNull()).drop(by)
    met = blocks(held.drop(*own), VECTOR_BLOCK, ("ids", "v")).crossJoin(blocks(free, QUERY_BLOCK, ("qids", "q")))
    if by is None:
        return nearest_in(met, n)
    some = lambda rows, size, names: blocks(rows.where(F.col(by).isNotNull()), size, names, by)
    inside = some(held, VECTOR_BLOCK, ("ids", "v")).join(some(asked, QUERY_BLOCK, ("qids", "q")), by)
    return nearest_in(inside.select("qids", "q", "ids", "v").unionByName(met.select("qids", "q", "ids", "v")), n)


def scored(hits: DataFrame) -> DataFrame:
    """hits (distance, text) with score: 1 - distance, less a penalty for short texts, rounded to 4 places."""
    return hits.withColumn("score", F.round(1 - F.col("distance") - short_penalty(F.col("text")), 4))


def current(hits: DataFrame, units: DataFrame, stored: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Hits (id) on units that exist, were not excluded, and whose stored hash is that of the unit."""
    if exclude is not None:
        hits = hits.join(exclude.select("id"), "id", "left_anti")
    found = hits.join(units, "id")
    if stored is not None:
        found = found.join(stored.select("id", F.col("embed_hash").alias("_stored")), "id").where(F.col("_stored") == F.col("embed_hash")).drop("_stored")
    return found


def page_gate(hits: DataFrame, matches: Column) -> DataFrame:
    """Hits of each query that match; all of a query's hits if none does."""
    some = F.max(matches.cast("int")).over(Window.partitionBy("qid"))
    return hits.withColumn("_m", matches).withColumn("_some", some).where(F.col("_m") | (F.col("_some") == 0)).drop("_m", "_some")


def path_matches(concept: Column, path: Column) -> Column:
    shown = F.lower(F.array_join(path, " > "))
    return F.exists(concept_tokens(concept), lambda t: F.contains(shown, t))


def ranked(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "distance", "id")))


def margin_cut(hits: DataFrame, max_distance: float = MAX_DISTANCE, margin: float = DISTANCE_MARGIN) -> DataFrame:
    """Ranked hits no farther than max_distance, nor than margin beyond the distance of the hit of rank 1."""
    best = F.min_by("distance", "rank").over(Window.partitionBy("qid"))
    return hits.withColumn("_cut", F.least(F.lit(max_distance), best + margin)).where(F.col("distance") <= F.col("_cut")).drop("_cut")


def numbered(hits: DataFrame, k: int = 5) -> DataFrame:
    """The first k hits of each query, numbered from 1 without gaps."""
    no = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return hits.withColumn("no", no).where(F.col("no") <= k)


def find(queries: DataFrame, vectors: DataFrame, units: DataFrame, n: int = FETCH_LIMIT, fit: Column | None = None, by: str | None = None, **valid: DataFrame) -> DataFrame:
    """queries (qid, concept, vector) -> ranked hits with the units' columns (id, text, path, ...), score and rank.

    by: a column of queries and vectors (book_id): the nearest are sought among vectors of the query's value (top_n).
    """
    hits = current(top_n(queries.select("qid", "vector", *([] if by is None else [by])), vectors, n, by), units, **valid)
    hits = scored(hits).join(queries.select("qid", "concept"), "qid")
    hits = page_gate(hits, path_matches(F.col("concept"), F.col("path")))
    return ranked(hits if fit is None else hits.where(fit.isNull()))


def retrieve(queries: DataFrame, vectors: DataFrame, units: DataFrame, k: int = 5, max_distance: float = MAX_DISTANCE, margin: float = DISTANCE_MARGIN, **options) -> DataFrame:
    return numbered(margin_cut(find(queries, vectors, units, **options), max_distance, margin), k)


def in_page(queries: DataFrame, units: DataFrame) -> DataFrame:
    """queries (qid, page_id, vector), units (id, page_id, vector) -> all units of the page, by similarity; no penalty, no gates."""
    dot = F.aggregate(F.zip_with(F.col("q"), F.col("vector"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    rows = queries.select("qid", "page_id", F.col("vector").alias("q")).join(units, "page_id").withColumn("score", F.round(dot, 4))
    return rows.withColumn("distance", 1 - F.col("score")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).drop("q")


def page_context(texts: Column, start: Column, end: Column, limit: int = 4000, mark: str = "<<핵심 문단>>") -> Column:
    """The page around a unit, the unit itself replaced by a mark.

    texts: the page's block texts (blank for what is left out, as code); the unit is blocks start to end. Blocks are
    taken to the left and to the right in turn, each for its length and one, as long as the limit allows.
    """
    n = F.size(texts)
    cost = lambda i: F.length(F.get(texts, i)) + 1
    zero = F.struct(start.cast("int").alias("a"), end.cast("int").alias("b"), F.lit(limit - len(mark)).alias("left"))

    def step(s: Column, turn: Column) -> Column:
        take_a = (turn % 2 == 0) & (s["a"] > 0) & (cost(s["a"] - 1) <= s["left"])
        take_b = (turn % 2 == 1) & (s["b"] < n) & (cost(s["b"]) <= s["left"])
        left = s["left"] - F.when(take_a, cost(s["a"] - 1)).when(take_b, cost(s["b"])).otherwise(0)
        return F.struct((s["a"] - take_a.cast("int")).alias("a"), (s["b"] + take_b.cast("int")).alias("b"), left.alias("left"))

    w = F.aggregate(F.sequence(F.lit(0), 2 * n + 1), zero, step)
    around = lambda a, b: F.filter(F.slice(texts, a + 1, b - a), lambda t: F.length(t) > 0)
    cut = lambda when, text: F.when(when, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    shown = F.concat(cut(w["a"] > 0, "...(앞부분 생략)"), around(w["a"], start), F.array(F.lit(mark)), around(end, w["b"]), cut(w["b"] < n, "...(뒷부분 생략)"))
    return F.array_join(shown, "\n")


def listing(hits: DataFrame, n: int = 5, chars: int = 80) -> DataFrame:
    """The first n ranked hits of each query as lines to look at: place, distance, where it stands, and the start of its text."""
    start = F.substring(F.trim(F.regexp_replace("text", "(?U)\\s+", " ")), 1, chars)
    line = F.format_string("%2d. %.3f %s | %s", F.col("no"), F.col("distance"), F.array_join("path", " > "), start)
    return numbered(hits, n).select("qid", "no", line.alias("line"))
