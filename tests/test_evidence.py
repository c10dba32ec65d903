"""Passages in texts against plain search, and scratch tables."""

from __future__ import annotations

import random
import re

import pytest

from pagemill.operators import evidence, retrieval, vectors
from pagemill.sources import scratch


def test_containing_finds_every_pair(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    passages = [phrase(rng.randrange(1, 12)) + rng.choice(["", ".", "!?"]) for _ in range(30)] + ["a", "", None, " .", phrase(3)]
    texts = []
    for _ in range(60):
        parts = [phrase(rng.randrange(0, 9)) for _ in range(3)]
        inside = rng.choice(passages[:30]) if rng.random() < 0.7 else ""
        texts.append(rng.choice([" ", "", "\n"]).join([parts[0], inside.replace(" ", rng.choice([" ", "  ", "\n"])).rstrip(".!?"), parts[1], parts[2]]) + ".")
    texts += [None, "", "a."]
    squash = lambda t: re.sub("[.!?]+$", "", re.sub(r"\s+", "", t))
    want = {(p, t) for p, x in enumerate(passages) for t, y in enumerate(texts) if x is not None and y is not None and squash(x) and squash(x) in squash(y)}
    got = evidence.containing(spark.createDataFrame(list(enumerate(texts)), "t_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "p_id long, text string"), "t_id", "p_id", gram=5, span=6)
    rows = [(r["p_id"], r["t_id"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 40


@pytest.mark.parametrize("sent, automaton", [(500_000, 20_000), (0, 7)])
def test_passages_of_every_length(spark, monkeypatch, sent, automaton):
    """Short ones by an automaton, long ones by grams; also with grams that are joined, and several automata."""
    monkeypatch.setattr(evidence, "SENT_GRAMS", sent)
    monkeypatch.setattr(evidence, "AUTOMATON", automaton)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abé한𝔘") for _ in range(n))
    texts = [letters(rng.randrange(120)) for _ in range(40)] + ["", None]
    passages = [t[at : at + n] for n in range(1, 60) for t in rng.sample(texts[:40], 2) for at in [rng.randrange(max(1, len(t) - n))]] + [letters(3), letters(3), "a", "a", None, ""]
    want = {(p, t) for p, x in enumerate(passages) for t, y in enumerate(texts) if x and y is not None and x in y}
    got = evidence.containing(spark.createDataFrame(list(enumerate(texts)), "t_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(passages)), "p_id long, text string"), "t_id", "p_id")
    rows = [(r["p_id"], r["t_id"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 200


def test_scratch_tables_are_removed(spark, tmp_path):
    scratch.remove_written(spark)
    df = scratch.written(spark.range(3).toDF("x"), "some")
    assert df.count() == 3 and scratch.remove_written(spark) == 1 and scratch.remove_written(spark) == 0


def test_spread_and_labels(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 2)
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = vectors.spread(v.where("id < 2 or id = 3").withColumnRenamed("id", "qid"), v).collect()
    assert {r["qid"]: (r["n"], round(r["least"], 6), round(r["mean"], 6), round(r["most"], 6)) for r in got} == {0: (2, 0.0, 0.353553, 0.707107), 1: (2, 0.0, 0.353553, 0.707107)}
    hits = spark.createDataFrame([(1, 7, 1, 0.25, ["A", "B"], " x\n y ")], "qid long, id long, rank int, distance double, path array<string>, text string")
    assert retrieval.listing(hits).first()["line"] == " 1. 0.250 A > B | x y"
    df = spark.createDataFrame([("A > B", "t\n" + "z" * 50)], "p string, t string")
    row = df.select(vectors.colour_label(df["p"]).alias("c"), vectors.row_label(df["t"]).alias("r")).first()
    assert row["c"] == "A" and row["r"] == "z" * 30 + "…"
