from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, key string"


def prose(rng, n):
    out = []
    while len(out) < n:
        out += [rng.choice(["the", "of", "and", "Ablen", "corti", "mina", "Über", "naïve", "restor", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(4, 14))]
        out[-1] += rng.choice([".", ".", "!", ",", ".\n"])
    return " ".join(out)


@pytest.fixture(scope="session")
def tricky_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, near and exact copies; columns with clashing names."""
    rng = random.Random(3)
    a, b = prose(rng, 300), prose(rng, 120)
    words = a.split(" ")
    near = " ".join([*words[:100], "changed", *words[101:]])
    passage = prose(rng, 60)
    texts = [(0, a, "s1"), (1, a, "s2"), (2, near, "s1"), (3, b, "s3"), (4, "", "s1"), (5, None, None), (6, " \t\n ", "s2"), (7, "x", None), (8, "one two", "s2"), (9, prose(rng, 60) + " " + passage + " " + prose(rng, 40), "s1"), (10, prose(rng, 50) + " and " + passage + " so " + prose(rng, 70), "s1"), (11, prose(rng, 30_000), "s1"), (None, b, "s1"), (12, b, "s9"), (12, b, "s9"), (13, "a b c " * 200, "s2"), (14, "SHOUT!! " * 80, "s2"), (15, "nav | bar | home | news | " * 30, "s2"), (-3, "Größe <|endoftext|> it's 3.14 naïve text\x85  end  \n\n done", "ü")]
    texts += [(100 + k, prose(rng, rng.randrange(20, 300)), rng.choice(["s1", "s1", "s2", "s3", None])) for k in range(60)]
    return [(i, t, None if k % 5 == 0 else "en", s, None, 7, 1, "k") for k, (i, t, s) in enumerate(texts)]


@pytest.fixture(scope="session")
def tricky(spark, tricky_rows):
    return spark.createDataFrame(tricky_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
