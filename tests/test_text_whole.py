"""Functions on whole texts: the same results as word by word, and each costly step once a row."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagemill.functions import text as T

GAPS = [" ", "\n", " ", "  \t", "　", "\x85", "  "]
WORDS = ["..", "?!", "~", ".a.", "a..b", "..뭐야?", "책이란", "책란", "책으로", "책로", "길로", "학교에서", "학교에", "학교로", "학교으로", "써?", "가", "𝒳은", "𝒳𝒴은", "a은", "순회하려면", "해요!", "어떤", "어떤것이", "에서", "이란", "란", "도", "만만", "책에도", "리스트이란", "사람이란.", "​", "\x1c", "_", "word,", "가a가", "무엇인가", "무엇인가요"]


def _white(s: str) -> list[str]:
    return [w for w in re.split(f"[{re.escape(T.WHITE)}]+", s) if w]


def _keywords(s: str) -> str:
    kept = []
    for w in _white(s):
        w = re.sub(r"^[?!.,~]+|[?!.,~]+\Z", "", w)
        if w and w not in T.QUESTION_WORDS and not re.search(T.VERB_ENDING, w):
            bare = re.sub(T.PARTICLE, "", w)
            kept.append(bare if len(bare) >= 2 else w)
    return " ".join(kept) or s


def test_keywords_of_whole_texts(spark):
    texts = ["", " ", "..", "\n?　", "왜? 뭐야", *WORDS]
    texts += [GAPS[k % 7].join(WORDS[(k * 5 + j * (k % 6 + 1)) % len(WORDS)] for j in range(9)) + GAPS[(k * 3) % 7] * (k % 2) for k in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.question_keywords(F.col("t")).alias("x")).collect()
    assert {texts[r["k"]]: r["x"] for r in rows} == {t: _keywords(t) for t in texts}


def test_strip_and_squash_of_white_space(spark):
    gap = T.WHITE
    rows = spark.createDataFrame([(gap + "a" + gap + "‘b’." + gap + "?!" + gap,), (gap,), ("\x1c a ​",), (None,)], "t string")
    found = [tuple(r) for r in rows.select(T.strip(F.col("t")), T.squash(F.col("t"))).collect()]
    assert found == [("a" + gap + "‘b’." + gap + "?!", "a'b'"), ("", ""), ("\x1c a ​", "\x1ca​"), (None, None)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_costly_steps_are_not_repeated(spark):
    rows = spark.createDataFrame([(1, "Some text")], "k int, t string").repartition(1)
    masked = rows.select(T.make_question(F.col("t"), F.col("t")).alias("q")).select("q.question", "q.blanks", "q.error")
    assert _plan(masked).count("_{3,}") == 1
    words = _plan(rows.select(T.question_keywords(F.col("t")).alias("x")))
    assert words.count(T.PARTICLE[:6]) == 1 and "split(" not in words
