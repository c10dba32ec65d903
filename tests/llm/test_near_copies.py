"""Near copies: pages of one template meet in proportion to their number, whatever counts as hot; the result stays exact."""

from __future__ import annotations

import random

import brute
import pytest

from pagemill.llm import components, near_copies
from pagemill.llm.minhash import minhash_components

SCHEMA = "doc_id long, text string"


def pages(n, common=60, own=14, seed=1):
    """Texts with a long part in common and a short one of their own, alike in less than 0.8."""
    rng = random.Random(seed)
    template = " ".join(f"t{k}" for k in range(common))
    return [(i, template + " " + " ".join(f"o{rng.randrange(10**8)}" for _ in range(own))) for i in range(n)]


def counted(monkeypatch):
    """Pairs that are compared, written into a list."""
    seen = []
    real = near_copies.written

    def written(df, what):
        found = real(df, what)
        if what == "pairs":
            seen.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "written", written)
    return seen


@pytest.mark.parametrize("sample, crowded", [(20_000, 1_000), (0, 10)])
def test_pages_of_a_template_do_not_all_meet(spark, monkeypatch, sample, crowded):
    """Once with hot shingles by a sample, once with those of full buckets only."""
    monkeypatch.setattr(near_copies, "SAMPLE_TEXTS", sample)
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    seen = counted(monkeypatch)
    for n in (60, 120):
        del seen[:]
        groups = near_copies.near_copy_components(spark.createDataFrame(pages(n), SCHEMA)).collect()
        assert all(r["id"] == r["component"] for r in groups) and len(groups) == n
        assert sum(seen) <= n, seen


@pytest.mark.parametrize("sample, crowded, rounds", [(20_000, 1_000, 3), (0, 5, 3), (0, 10**9, 1)])
def test_the_result_does_not_depend_on_what_is_hot(spark, monkeypatch, sample, crowded, rounds):
    for name, value in (("SAMPLE_TEXTS", sample), ("CROWDED", crowded), ("ROUNDS", rounds)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(9)
    texts = pages(20) + [(100 + i, t) for i, t in pages(30, 56, 7, seed=2)] + [(200 + i, t) for i, t in pages(12, 60, 5, seed=3)]
    texts += [(300 + i, " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    for k in range(40):
        words = rng.choice(texts[:62])[1].split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append((400 + k, " ".join(words[: len(words) - rng.randrange(12)])))
    sets = {i: frozenset(brute.shingles(t, 5)) for i, t in texts}
    alike = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    want = brute.components(sets, alike)
    docs = spark.createDataFrame(texts, SCHEMA).repartition(4)
    assert {r["id"]: r["component"] for r in near_copies.near_copy_components(docs).collect()} == want
    assert len(set(want.values())) < len(texts) - 60


def test_rests_rule_out_pairs_before_they_are_made(spark):
    """A bucket of many sets whose shared element stands far back, and some where it stands in front."""
    rows = [(1, k, 70, 56) for k in range(500)] + [(2, k, 70, 70) for k in range(500, 520)]
    pairs = []

    def verified(found):
        pairs.append(found.count())
        return found.limit(0)

    components.bucket_links(spark.createDataFrame(rows, "key long, node long, n long, rest long"), None, verified, 0.8).count()
    assert pairs == [19, 190]


def test_minhash_of_pages(spark):
    texts = pages(30) + [(100, pages(30)[3][1]), (101, pages(30)[4][1] + " end")]
    got = {r["id"]: r["class_id"] for r in minhash_components(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == {i: {100: 3, 101: 4}.get(i, i) for i, _ in texts}
