"""Search within books and through the index on disk, against plain products of all vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.operators import retrieval, vector_index

DATA = "/root/testdata"


def plain(m, q, n, allowed=None):
    """(distance, id) of the n nearest rows of m to q."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
    far = 1 - unit(m) @ unit(q)
    return sorted((round(float(far[i]), 9), i) for i in range(len(m)) if allowed is None or allowed[i])[:n]


def told(rows):
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append((round(r["distance"], 9), r["id"]))
    return {k: sorted(v) for k, v in got.items()}


@pytest.fixture(scope="module")
def cloud():
    """Points around a few centres, copies of some, and a vector without direction."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    m = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.4
    m[40:60] = m[7]
    m[100] = 0
    return m


def frame(spark, m, books=None):
    rows = [(i, [float(x) for x in v], None if books is None else books[i]) for i, v in enumerate(m)]
    return spark.createDataFrame([*rows, (10_000, None, 1)], "id long, vector array<double>, book_id long").repartition(6)


@pytest.mark.parametrize("blocks", [(4096, 512), (30, 4)])
def test_top_n_within_books(spark, cloud, monkeypatch, blocks):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks[1])
    books = [None if i % 17 == 0 else 1 if i % 3 else i % 40 for i in range(len(cloud))]  # book 1 holds most
    v = frame(spark, cloud, books)
    q = v.where("id % 10 = 3 or id % 17 = 0").withColumnRenamed("id", "qid")
    got = told(retrieval.top_n(q, v, 7, by="book_id").collect())
    asked = [i for i in range(len(cloud)) if i % 10 == 3 or i % 17 == 0]
    assert sorted(got) == asked
    for i in asked:
        assert got[i] == plain(cloud, cloud[i], 7, None if books[i] is None else [b == books[i] for b in books]), i
    assert retrieval.top_n(q.limit(0), v, 7, by="book_id").count() == 0


def test_a_query_meets_only_its_own_books_blocks(spark, cloud):
    v = frame(spark, cloud, [i % 9 for i in range(len(cloud))])
    q = v.where("id = 5").withColumnRenamed("id", "qid")
    plan = retrieval.top_n(q, v, 7, by="book_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (book_id" in plan


@pytest.mark.parametrize("n", [1, 7, 300, 2000])
def test_index_search_is_exact(spark, cloud, tmp_path, n):
    v = frame(spark, cloud)
    path = f"file://{tmp_path}/index"
    vector_index.build_index(v, path, lists=15)
    assert vector_index.rows_of(spark, path).count() == len(cloud)
    q = v.where("id % 50 = 0 or id = 7 or id > 900").withColumnRenamed("id", "qid")
    got = told(vector_index.search(q, path, n).collect())
    assert sorted(got) == sorted({*range(0, 900, 50), 7})
    for i, rows in got.items():
        want = plain(cloud, cloud[i], n)
        assert [d for d, _ in rows] == pytest.approx([d for d, _ in want], abs=1e-8) and len({x for _, x in rows}) == len(want)
        assert {x for d, x in rows if d < want[-1][0] - 1e-8} == {x for d, x in want if d < want[-1][0] - 1e-8}


def test_a_search_reads_the_lists_it_wants(spark, cloud, tmp_path):
    v = frame(spark, cloud)
    path = f"file://{tmp_path}/index"
    vector_index.build_index(v, path, lists=20)
    q = v.where("id = 3").withColumnRenamed("id", "qid")
    met = vector_index._met(spark, path, vector_index._asked(q.select("qid", "vector"), lambda b, m: [np.array([0, 1])]))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and met.count() > 0
    lists = vector_index.Lists(spark, path)
    near = lists.nearest_possible(cloud[3:4] / np.linalg.norm(cloud[3]))
    reached = plain(cloud, cloud[3], 7)[-1][0]
    assert (near <= reached).sum() < len(lists.n) / 2  # most lists are ruled out by the bound


def test_no_list_holds_anything_below_its_bound(spark, cloud, tmp_path):
    v = frame(spark, cloud)
    path = f"file://{tmp_path}/index"
    vector_index.build_index(v, path, lists=12)
    lists, unit = vector_index.Lists(spark, path), cloud / np.maximum(np.linalg.norm(cloud, axis=1, keepdims=True), 1e-300)
    own = {r["id"]: r["list"] for r in vector_index.rows_of(spark, path).select("id", "list").collect()}
    bound = lists.nearest_possible(unit)
    place = {k: n for n, k in enumerate(lists.numbers.tolist())}
    far = 1 - unit @ unit.T
    for i, k in own.items():
        if k != vector_index.NO_DIRECTION:
            assert (far[:, i] >= bound[:, place[k]] - 1e-9).all()


def test_recall_of_a_few_lists_and_an_index_without_rows(spark, tmp_path):
    v = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path, q = f"file://{tmp_path}/index", v.where("id % 50 = 0").withColumnRenamed("id", "qid")
    vector_index.build_index(v, path)
    exact = {(r["qid"], r["id"]) for r in retrieval.top_n(q, v, 10).collect()}
    found = {(r["qid"], r["id"]) for r in vector_index.search(q, path, 10, probes=math.isqrt(500) // 2).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    empty = f"file://{tmp_path}/empty"
    vector_index.build_index(v.limit(0), empty)
    assert vector_index.search(q, empty, 10).count() == 0
    assert vector_index.search(q.limit(0), path, 10).count() == 0


def test_many_copies_of_queries_are_shuffled(spark, tmp_path, monkeypatch):
    """The second look sends a query to bundles, not to each list, and no table of copies is broadcast."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 16)))]
    rows += [(7, rows[7][1]), (900, [0.0] * 16), (901, [0.0] * 16)]  # an id twice, and vectors without direction
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id % 50 = 0 or id = 7").withColumnRenamed("id", "qid")
    monkeypatch.setattr(vector_index, "VECTOR_BLOCK", 200)
    path = str(tmp_path / "index")
    vector_index.build_index(v, path, lists=40)
    tables, wrote = [], vector_index.written
    monkeypatch.setattr(vector_index, "written", lambda df, what: tables.append((what, wrote(df, what))) or tables[-1][1])
    found = vector_index.search(q, path, 10)
    copies = [t for what, t in tables if what == "asked"][-1]
    assert copies.count() <= 5 * q.count()  # of 40 lists, four bundles of vectors with a direction, and one without
    assert "SortMergeJoin [bundle" in found._jdf.queryExecution().toString()
    key = lambda df: sorted((r["qid"], r["id"], round(r["distance"], 9)) for r in df.distinct().collect())
    assert key(found) == key(retrieval.top_n(q, v, 10))


def test_memory_of_a_task_is_bounded(spark, monkeypatch):
    """Vectors of floats are not widened on their way, products and best rows come in slices, and nothing depends on the slices."""
    rows = spark.range(0, 700, 1, 2).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(1000)) / 1000).cast("float")).alias("vector"))
    asked = rows.where("id % 10 = 0").withColumnRenamed("id", "qid")
    met = retrieval.blocks(rows, 300, ("ids", "v"))
    assert met.schema["v"].dataType.simpleString() == "array<float>"
    assert retrieval.blocks(rows.withColumn("vector", F.col("vector").cast("array<double>")), 300, ("ids", "v")).schema["v"].dataType.simpleString() == "array<double>"
    whole = sorted(map(tuple, retrieval.top_n(asked, rows, 7).collect()))
    monkeypatch.setattr(retrieval, "SLICE", 64)
    monkeypatch.setattr(retrieval, "GIVEN_QUERIES", 3)
    parts = sorted(map(tuple, retrieval.top_n(asked, rows, 7).collect()))
    assert len(parts) == 490 and [r[:2] for r in parts] == [r[:2] for r in whole] and max(abs(a[2] - b[2]) for a, b in zip(parts, whole, strict=True)) < 1e-12
    pair = pa.RecordBatch.from_pylist([{"qids": [1, 2], "q": [1.0, 0.0, 0.0, 1.0], "ids": list(range(150)), "v": [1.0, 1.0] * 150}])
    assert [d.shape for _, d, _ in retrieval.distances(iter([pair]), 64)] == [(2, 64), (2, 64), (2, 22)]
    assert [d.shape for _, d, _ in retrieval.distances(iter([pair]))] == [(2, 150)]
