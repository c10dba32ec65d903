"""Embedding models: batches of like length under a bound of tokens, one load a worker, checked vectors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import providers
from pagemill.operators import index


def test_batches_are_bounded_and_alike():
    rng = random.Random(4)
    for sizes in ([], [5], [500], [3] * 40, [rng.randrange(300) for _ in range(200)], [0, 0, 0]):
        batches = index.token_batches(sizes, 400, 16)
        assert sorted(i for b in batches for i in b) == list(range(len(sizes)))
        for b in batches:
            assert len(b) <= 16 and (len(b) == 1 or max(sizes[i] for i in b) * len(b) <= 400)
        order = [sizes[i] for b in batches for i in b]
        assert order == sorted(order, reverse=True)
    # padding costs little: like lengths stand together
    sizes = [rng.choice([10, 200]) for _ in range(300)]
    padded = sum(max(sizes[i] for i in b) * len(b) for b in index.token_batches(sizes, 2000, 64))
    assert padded <= 1.1 * sum(sizes)


def model(path, **more):
    """Writes down loads and batches; made here, so that it travels to the workers by value."""

    def load():
        import os

        with open(path, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def encode(texts):
            with open(path, "a") as f:
                f.write(f"batch {len(texts)} {max(len(t.split()) for t in texts)}\n")
            return providers.hashing_embed(texts)

        return encode

    return index.Model(path, load, **more)


def rows(spark, n):
    text = F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id").cast("string")), (F.col("id") % 30 + 1).cast("int")))
    df = spark.range(n).select(F.col("id").cast("string").alias("unit_id"), text.alias("embed_text"))
    return df.withColumn("embed_hash", F.md5("embed_text"))


STORED = "unit_id string, embed_hash string, embedding array<float>"


def test_a_worker_loads_its_model_once(spark, tmp_path):
    path, none = f"{tmp_path}/log", spark.createDataFrame([], STORED)
    got = index.embedded(rows(spark, 300).repartition(8), none, model(path, most_tokens=100, most_texts=10)).collect()
    assert len(got) == 300 and all(r["embedding"] == pytest.approx(providers.hashing_embed([r["embed_text"]])[0]) for r in got)
    said = [x.split() for x in open(path).read().splitlines()]  # noqa: SIM115
    loads = [x[1] for x in said if x[0] == "load"]
    assert loads and len(loads) == len(set(loads))
    batches = [(int(x[1]), int(x[2])) for x in said if x[0] == "batch"]
    assert sum(n for n, _ in batches) == 300 and all(n <= 10 and (n == 1 or n * longest <= 100) for n, longest in batches) and len(batches) < 150


def test_vectors_are_checked(spark, tmp_path):
    none = spark.createDataFrame([], STORED)
    long = index.Model(f"{tmp_path}/a", lambda: lambda texts: [[2.0, 0.0] for _ in texts])
    with pytest.raises(Exception, match="length one"):
        index.embedded(rows(spark, 3), none, long).collect()
    few = index.Model(f"{tmp_path}/b", lambda: lambda texts: [[1.0]])
    with pytest.raises(Exception, match="1 vectors for 3 texts"):
        index.embedded(rows(spark, 3).coalesce(1), none, few).collect()
    free = index.Model(f"{tmp_path}/c", lambda: lambda texts: [[2.0, 0.0] for _ in texts], unit_length=False)
    assert index.embedded(rows(spark, 3), none, free).count() == 3


def test_counts_come_with_the_job_that_writes(spark):
    from pagemill.sources.scratch import counted

    df = spark.range(1000).withColumn("odd", F.col("id") % 2 == 1)
    context = spark.sparkContext
    context.setJobGroup("counted", "")
    rows, seen = counted(df, "some", n_odd=F.count_if("odd"), most=F.max("id"))
    jobs = len(context.statusTracker().getJobIdsForGroup("counted"))
    context.setJobGroup("", "")
    assert seen == {"n_odd": 500, "most": 999} and rows.count() == 1000 and jobs == 1
    empty, seen = counted(df.where("id < 0"), "none", n_odd=F.count_if("odd"), most=F.max("id"))
    assert empty.count() == 0 and seen == {"n_odd": 0, "most": None}
