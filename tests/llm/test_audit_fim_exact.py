"""Filter audit, fill-in-middle and exact dedup against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from pagemill.llm import audit, exact, fim
from pagemill.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata"
TEXTS = [
    "", None, " ", "\n\n", "a", "A", "é", "ab cd", "ab  cd", "ab\tcd\n", "AB cd", "<P>", "x<S>y", "a<M>b", "<", "<<", ">S>", "<P", "S>", "<P<S", "P>S>M>", "日本 go 語", "\x00\x01", "a b", "a b c",
    "x" * 5000, "x " * 5000, "#", "Cash $5 & more", "word " * 49, "word " * 50, " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k % 33}" for k in range(50)), " ".join(f"w{k % 32}" for k in range(50)), "A" * 5 + "b" * 95, "A" * 6 + "b" * 94,
]


def rows_to_test():
    rng = random.Random(4)
    rows = [(k, t, rng.choice(["s", "t", None, ""])) for k, t in enumerate(TEXTS)]
    rows += [(100 + k, "".join(rng.choice("ab AB<>PSM\n é日#1") for _ in range(rng.randrange(90))), rng.choice(["s", "t", None])) for k in range(200)]
    rows += [(400 + k, " ".join(rng.choice(["the", "The", "cat", "of", "ÉTÉ", f"n{rng.randrange(60)}"]) for _ in range(rng.randrange(20, 120))), "s") for k in range(60)]
    copies = [(600 + k, rng.choice(rows)[1], rng.choice(["s", "u"])) for k in range(80)]
    spaced = [(700 + k, (rng.choice(rows)[1] or "").replace(" ", rng.choice(["", "  ", "\n"])), "t") for k in range(60)]
    # repeated ids, repeated rows, null ids
    return rows + copies + spaced + [(5, "twice", "s"), (5, "twice", "s"), (6, "twice", "t"), (None, "twice", "s"), (None, "twice", "s"), (None, "alone", None), (None, None, None)]


SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Columns of the caller have names that the operators use inside."""
    found = spark.createDataFrame(rows_to_test(), SCHEMA).repartition(5)
    return found.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in ("id", "row", "h", "word", "bit", "bits", "digest", "left_over", "part", "mask", "n", "form", "output", "first", "d", "kept", "label_id")]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 800, 3)] + [(6, 1, 0), (6, 0, 1), (6, None, None), (None, 1, 1), (9999, 1, 1)]


def test_audit_against_filters_applied_in_turn(spark, docs, empty):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, *x in LABELS if i is not None and x[k] == 1} for k in (0, 1))
    want = brute.audit([(i, p, t) for i, t, p in rows_to_test()], good, toxic)
    got = audit.audit(docs, labels).collect()
    assert len(got) == len(want) == len({(r["part"], r["filter_order"], r["step"]) for r in got})
    for r in got:
        assert tuple(r[3:]) == want[r["part"], r["filter_order"], r["step"]], r
    assert {"", "s", "t", "u"} == {r["part"] for r in got}
    assert audit.audit(empty, labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).where("good_lost <> 0 or toxic_lost <> 0").count() == 0


def test_gray_walk_is_the_sum_over_cells(spark):
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, (7, 32, 3))
    states = audit.gray_walk(counts)
    for subset in range(32):
        cells = [m for m in range(32) if not m & subset]
        assert (states[:, subset] == counts[:, cells].sum(axis=1)).all()
    want = np.zeros((7, 5), np.int64)
    for order in itertools.permutations(range(5)):
        before = 0
        for f in order:
            want[:, f] += states[:, before, 0] - states[:, before | 1 << f, 0]
            before |= 1 << f
    assert (audit.in_all_orders(states[:, :, 0]) == want).all()


def test_fill_in_middle_against_one_text_at_a_time(docs, empty):
    made = fim.fill_in_middle(docs)
    assert {"row", "h", "word", "source"} <= set(made.columns) and "text" not in made.columns
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("text"), "source", "row").collect()
    texts = defaultdict(list)
    for i, t, _ in rows_to_test():
        texts[i].append(t or "")
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, own in texts.items() for t in own)
    for r in got:
        assert tuple(r[1:6]) == brute.fill_in_middle(r["doc_id"], r["text"]) and (r["row"] is None if r["doc_id"] is None else r["row"] == f"row-{r['doc_id']}")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).count() == 0


def test_units_and_pieces_of_blocks():
    texts = pa.array([t or "" for _, t, _ in rows_to_test()])
    for block in (texts, texts.slice(7, 20), texts.slice(3, 0), texts.slice(0, 1)):
        assert fim.unit_lists(block).to_pylist() == [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in block.to_pylist()]


def test_a_text_longer_than_a_block(spark):
    long = "Ab cé<" * 900_000
    rows = spark.createDataFrame([(k, long) for k in range(3)] + [(9, "short one")], "doc_id long, text string")
    made = fim.fill_in_middle(rows)
    got = made.select("doc_id", "n", F.sha2("output", 256).alias("o"), (F.sha2(fim.restored(F.col("output"), F.col("form")), 256)).alias("r")).collect()
    for r in got:
        text = long if r["doc_id"] < 9 else "short one"
        want = brute.fill_in_middle(r["doc_id"], text)
        assert (r["n"], r["o"], r["r"]) == (want[0], hashlib.sha256(want[4].encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_exact_groups_against_brute_force(docs, empty, monkeypatch, words):
    monkeypatch.setattr(exact, "BIT_WORDS", words)  # a table of 64 bits marks keys that are no group; nothing changes
    want = brute.exact_groups([(i, t) for i, t, _ in rows_to_test()])
    for every in (False, True):
        got = exact.exact_groups(docs, all_hashes=every).collect()
        assert Counter(tuple(r[:3]) for r in got) == Counter(w[:3] for w in want)
        may = {w[:3] for w in want if w[3]}
        assert all(tuple(r[:3]) in may for r in got if r["kept"])
        assert sum(r["kept"] for r in got) == len({"".join(brute.words(t)) for _, t, _ in rows_to_test()})
        assert not every or Counter(r["digest"] for r in got) == Counter(hashlib.sha256("".join(brute.words(t)).encode()).hexdigest() for _, t, _ in rows_to_test())
        assert all(r["digest"] is not None for r in got if r["group_size"] > 1)
    assert exact.exact_groups(empty).count() == 0


def test_only_texts_that_are_left_over_are_hashed(spark):
    rows = [(k, f"{k:04d} " + "x" * k) for k in range(300)] + [(1000, "0007 xxxxxxx"), (1001, "0299" + "x" * 299)]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).where("digest is not null").collect()
    assert {7, 299, 1000, 1001} <= {r["id"] for r in got} and len(got) < 30
    assert {(r["id"], r["keep_id"], r["kept"]) for r in got if r["group_size"] > 1} == {(7, 7, True), (1000, 7, False), (299, 299, True), (1001, 299, False)}


def test_without_copies(docs, empty):
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    want = brute.exact_groups([(i, t) for i, t, _ in rows_to_test()])
    assert len(got) == len({"".join(brute.words(t)) for _, t, _ in rows_to_test()})
    assert all(r["row"] is None if r["doc_id"] is None else r["row"] == f"row-{r['doc_id']}" for r in got)
    best = {}
    for (i, t, _), x in zip(rows_to_test(), want, strict=True):
        if x[3]:
            best["".join(brute.words(t))] = (i, t or "")
    assert {"".join(brute.words(r["text"])): (r["doc_id"], r["text"] or "") for r in got} == best
    assert exact.without_copies(empty).count() == 0


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_fill_in_middle", "op13_exact_duplicates"])
def test_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()) == rows_of(duck(ORACLE_SQL[name]))
