"""Looking at vectors: statistics, dimensions by variance, similarity, projection to a plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import QUERY_BLOCK, VECTOR_BLOCK, blocks, distances

SNIPPET_CHARS, LABEL_CHARS = 160, 30
#: Ranges of a histogram, and how many values are few enough to be sorted.
HISTOGRAM, FEW = 1024, 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def selected(vectors: DataFrame, ids: DataFrame | None = None, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Vectors of given ids (id, ord) in their order, or by a condition in the order of page, number and id."""
    if ids is not None:
        return vectors.join(ids, "id").orderBy("ord", "id")
    rows = vectors if where is None else vectors.where(where)
    number = F.regexp_extract(F.col("id").cast("string"), "-(\\d+)", 1).try_cast("int")
    rows = rows.orderBy(*([F.col("page_id")] if "page_id" in rows.columns else []), number, "id")
    return rows if limit is None else rows.limit(limit)


def stats(vectors: DataFrame, first: Column) -> DataFrame:
    """vectors (id, v) -> norm, min, max, mean, entries beyond 0.1, and cosine to a given vector."""
    v = F.col("v")
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.select("id", norm(v).alias("norm"), F.array_min(v).cast("double").alias("min"), F.array_max(v).cast("double").alias("max"), (total / F.size(v)).alias("mean"), F.size(F.filter(v, lambda x: F.abs(x) > 0.1)).alias("n_large"), (dot(v, first) / (norm(v) * norm(first))).alias("cosine"))


def dimensions(vectors: DataFrame) -> DataFrame:
    """(dim, variance, place): population variance of each dimension, and its place from the largest."""
    long = vectors.select(F.posexplode("v").alias("dim", "x"))
    found = long.groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("variance"), "dim")))  # a row for each dimension


def similarity(some: DataFrame) -> DataFrame:
    """some (id, v) -> (a, b, cosine) for a < b. For a selection that is looked at; the pairs grow with its square."""
    a, b = some.select(F.col("id").alias("a"), F.col("v").alias("va")), some.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (dot(F.col("va"), F.col("vb")) / (norm(F.col("va")) * norm(F.col("vb")))).alias("cosine"))


def spread(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """queries (qid, vector), vectors (id, vector) -> for each query the number, minimum, mean and maximum of its cosines to all
    vectors of other ids.

    Queries and vectors meet in blocks, as matrix products; a pair of blocks gives one row a query. Null vectors are left out.
    """
    q = blocks(queries.where("vector is not null").select(F.col("qid").cast("long"), "vector"), QUERY_BLOCK, ("qids", "q"))
    v = blocks(vectors.where("vector is not null").select(F.col("id").cast("long"), "vector"), VECTOR_BLOCK, ("ids", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, far, ids in distances(batches):
            other = qids[:, None] != ids[None, :]
            near = np.where(other, 1 - far, np.nan)
            n = other.sum(axis=1)
            some = n > 0
            near, qids, n = near[some], qids[some], n[some]
            yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(n), pa.array(np.nanmin(near, axis=1)), pa.array(np.nansum(near, axis=1)), pa.array(np.nanmax(near, axis=1))] if len(qids) else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())], names=["qid", "n", "least", "total", "most"])

    met = v.crossJoin(q).select("qids", "q", "ids", "v").mapInArrow(run, "qid long, n long, least double, total double, most double")
    return met.groupBy("qid").agg(F.sum("n").alias("n"), F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"))


def centres(vectors: DataFrame, label: str) -> DataFrame:
    """vectors (label, v) -> for each label the number of its vectors and their mean."""
    long = vectors.select(label, F.posexplode("v").alias("i", "x"))
    mean = long.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))


def kth_smallest(values: DataFrame, k: int) -> float:
    """The k-th smallest (from 0) of values (x double, no nulls), exactly, without bringing values together.

    Rounds of range histograms: each counts the values in HISTOGRAM equal ranges between the ends known so far, a row for a
    range, and goes on in the range that holds the k-th; its own least and greatest value are the next ends, so gaps and
    ties cost no rounds. A range of few values, or of one, ends it.
    """
    low, high, below = None, None, 0
    ends = values.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    low, high = ends["low"], ends["high"]
    while low < high:
        width = high - low
        if width in (0.0, float("inf")):  # ends so far apart that their difference is no number: halve them first
            place = F.when(F.col("x") < low / 2 + high / 2, 0).otherwise(1)
        else:
            place = F.least(F.floor((F.col("x") - low) / width * HISTOGRAM), F.lit(HISTOGRAM - 1))
        within = values.where(F.col("x").between(low, high))
        found = within.groupBy(place.cast("int").alias("place")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("place").collect()  # HISTOGRAM rows at most
        for r in found:
            if below + r["n"] > k:
                break
            below += r["n"]
        if r["n"] <= FEW or (len(found) == 1 and r["n"] <= HISTOGRAM * FEW):
            rows = values.where(F.col("x").between(r["low"], r["high"])).orderBy("x").limit(k - below + 1)
            return rows.agg(F.max("x")).first()[0]
        low, high = r["low"], r["high"]
    return low


def percentile(values: DataFrame, share: float) -> float | None:
    """The share-percentile of values (x double), exactly, between the two values nearest to it in proportion; None of no values.

    Nulls and NaN are left out.
    """
    held = values.where(F.col("x").isNotNull() & ~F.isnan("x"))
    n = held.count()
    if not n:
        return None
    place = share * (n - 1)
    k = int(place)
    first = kth_smallest(held, k)
    if place == k:
        return first
    after = held.agg(F.count_if(F.col("x") <= first).alias("upto"), F.min(F.when(F.col("x") > first, F.col("x"))).alias("next")).first()
    second = first if after["upto"] > k + 1 else after["next"]
    return first + (second - first) * (place - k)


def heatmap(vectors: DataFrame, first: int = 32) -> DataFrame:
    """The dimensions of largest variance as rows (dim, variance, place, bound), places up to first; bound: the 99th percentile of
    all absolute values, where a colour scale ends."""
    top = dimensions(vectors).where(F.col("place") <= first)
    bound = percentile(vectors.select(F.explode("v").alias("y")).select(F.abs(F.col("y").cast("double")).alias("x")), 0.99)
    return top.withColumn("bound", F.lit(bound).cast("double"))


def row_label(text: Column, chars: int = LABEL_CHARS) -> Column:
    """A short label of a row: the start of its text, on one line."""
    return snippet(text, chars)


def colour_label(path: Column) -> Column:
    """What points are coloured by: the chapter, which is the first part of the path."""
    return F.coalesce(F.get(F.split(path, " > "), F.lit(0)), F.lit(""))


def plane(vectors: DataFrame, k: int = 2) -> DataFrame:
    """vectors (id, v) with coords: the first k principal components, after centering. Signs are free."""
    centre = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    middle = [r["m"] for r in centre.orderBy("dim").collect()]  # one number for each dimension
    centred = F.transform("v", lambda x, i: x.cast("double") - F.get(F.array(*map(F.lit, middle)), i))
    rows = vectors.withColumn("_c", array_to_vector(centred))
    return PCA(k=k, inputCol="_c", outputCol="_p").fit(rows).transform(rows).withColumn("coords", vector_to_array("_p")).drop("_c", "_p")


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    """The start of a text after its first line, on one line."""
    body = F.regexp_replace(text, "^[^\\n]*\\n?", "")
    flat = F.trim(F.regexp_replace(body, "(?U)\\s+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars), F.lit("…"))).otherwise(flat)


def wide(vectors: DataFrame, size: int, prefix: str = "d") -> DataFrame:
    """id and a column for each dimension, for export."""
    return vectors.select("id", *[F.get("v", F.lit(i)).alias(f"{prefix}{i}") for i in range(size)])
