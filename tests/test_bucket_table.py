"""The table of buckets: what a change rewrites, and what stays readable."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.sources.bucket_table import BucketTable

SCHEMA = "id string, x long, v array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(k, x, [float(x or 0), 1.0]) for k, x in rows], SCHEMA).repartition(3)


def held(table, version=None):
    return {r["id"]: r["x"] for r in table.read(version).collect()}


def test_a_change_of_one_row_writes_one_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = BucketTable(spark, path, SCHEMA, "id", buckets=16)
    assert table.version() is None and table.read().count() == 0 and table.digest() == ""
    assert table.upsert(frame(spark, [(f"k{i}", i) for i in range(300)])) == 1
    first = {e["bucket"]: e for e in table.manifest(1)}
    assert sum(e["n"] for e in first.values()) == 300 and len(first) == 16
    assert table.upsert(frame(spark, [("k7", -7)])) == 2
    second = {e["bucket"]: e for e in table.manifest(2)}
    changed = [b for b in first if first[b]["folder"] != second[b]["folder"]]
    assert len(changed) == 1 and second[changed[0]]["n"] == first[changed[0]]["n"]
    new = second[changed[0]]["folder"].split("/")[1]
    assert [p.name for p in (tmp_path / "t" / "rows" / new).iterdir() if p.name.startswith("_bucket")] == [f"_bucket={changed[0]}"]
    assert held(table) == {f"k{i}": -7 if i == 7 else i for i in range(300)} and held(table, 1)["k7"] == 7
    # another reader finds the number of buckets in the manifest
    assert BucketTable(spark, path, SCHEMA, "id").buckets == 16


def test_rows_that_are_there_already_change_nothing(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", buckets=4)
    rows = frame(spark, [(f"k{i}", i) for i in range(40)] + [("null", None)])
    assert table.upsert(rows) == 1 and table.upsert(rows.where("x > 5 or x is null")) is None and table.replace(rows) is None
    assert table.version() == 1 and len(list((tmp_path / "t" / "rows").iterdir())) == 1
    assert table.replace(rows.where("x < 3")) == 2 and held(table) == {"k0": 0, "k1": 1, "k2": 2}
    assert table.replace(rows.limit(0)) == 3 and held(table) == {} and len(held(table, 1)) == 41
    assert table.digest(1) != table.digest(2) != table.digest(3) == ""
    assert table.upsert(rows.limit(0)) is None


def test_random_changes_against_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    table, want, kept = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", buckets=5), {}, {}
    for _ in range(5):
        rows = {f"k{rng.randrange(30)}": rng.randrange(100) for _ in range(rng.randrange(1, 12))}
        want |= rows
        version = table.upsert(frame(spark, list(rows.items())))
        kept[version or table.version()] = dict(want)
        assert held(table) == want
    for version, rows in kept.items():
        assert held(table, version) == rows
    assert table.forget(keep=2) > 0 and held(table) == want and len(table.versions()) == 2


def test_keys(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", buckets=3)
    with pytest.raises(ValueError):
        table.upsert(frame(spark, [(None, 1)]))
    assert table.version() is None
    # of rows of one key one is taken, the same whatever their order
    twice = frame(spark, [("a", 1), ("a", 2), ("a", 3)])
    table.upsert(twice)
    assert table.upsert(twice.orderBy(F.desc("x"))) is None and len(held(table)) == 1


def test_an_unfinished_change_is_not_seen_and_two_at_once_meet(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = BucketTable(spark, path, SCHEMA, "id", buckets=3)
    table.upsert(frame(spark, [("a", 1)]))
    (tmp_path / "t" / "manifests" / "v0000000002").mkdir()  # a job died while it wrote its manifest
    assert table.version() == 1 and held(table) == {"a": 1}
    with pytest.raises(Exception, match="(?i)exist"):
        table.upsert(frame(spark, [("a", 2)]))
    assert held(table) == {"a": 1}
