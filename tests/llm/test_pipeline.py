"""The pipeline's stages on tricky rows: columns, decisions, and the whole run."""

from __future__ import annotations

import brute
import corpus_pipeline as cp

DATA = "/root/testdata"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tricky, nothing):
    docs = tricky.select(*COLUMNS)
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    a = cp.quality_rules(spark, docs, "").cache()
    assert a.columns == COLUMNS and {0, 1, 2, 3, 9, 10} <= {r["doc_id"] for r in a.collect()} and not a.where("doc_id in (4, 5, 13, 14, 15)").count()
    b = cp.near_dedup(spark, a, "").cache()
    kept = [r["doc_id"] for r in b.collect()]
    assert b.columns == COLUMNS and {0, 3, 9, 10} <= set(kept) and not {1, 2, 12} & set(kept) and len(kept) == len(set(kept))
    c = cp.substring_dedup(spark, b, "").cache()
    assert c.columns == COLUMNS and all(r["n_chars"] == len(r["text"]) and brute.words(r["text"]) for r in c.collect())
    d = cp.mix_sources(spark, c, "")
    assert d.columns == COLUMNS and d.count() > 0
    e = cp.pack_sequences(spark, d, "")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(e.columns)
    docs = nothing.select(*COLUMNS)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_near_dedup_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    good = cp.quality_rules(spark, docs, "").cache()
    kept = {r["doc_id"] for r in cp.near_dedup(spark, good, "").collect()}
    sets = {r["doc_id"]: frozenset(brute.shingles(r["text"], 5)) for r in good.collect()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in sets:
        if i in kept:
            assert not any(j < i and like(i, j) >= 0.8 for j in kept)
        else:
            assert any(like(i, j) >= 0.6 for j in sets if j != i)


def test_run(spark):
    rows = cp.run(spark, f"{DATA}/sf0.001").collect()
    assert sum(r["length"] for r in rows if r["offset"] == 0) > 0


def test_quality_sql(spark, duck):
    from helpers import rows_of

    from pagemill.llm.queries import ORACLE_SQL, QUERIES

    assert rows_of(QUERIES["op5_quality_rules"](spark, f"{DATA}/sf0.001").toPandas()) == rows_of(duck(ORACLE_SQL["op5_quality_rules"]))


def test_near_dedup_is_exact_at_the_threshold(spark):
    import random

    rng = random.Random(8)
    texts, common = [], [f"common{k}" for k in range(12)]
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts.append(base)
        for k in (1, 2, 3, 4, 5, 6):  # k changed words, five shingles each: likeness from 0.9 to 0.5
            other = list(base)
            for at in range(k):
                other[8 + 13 * at] = f"x{rng.randrange(10**6)}"
            texts.append(other)
    texts += [common + [f"y{rng.randrange(10**6)}" for _ in range(40)] for _ in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = {i: frozenset(brute.shingles(" ".join(t), 5)) for i, t in enumerate(texts)}
    groups = brute.components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r["doc_id"] for r in cp.near_dedup(spark, docs, "").collect()} == set(groups.values())
