"""Text functions against cases by hand and small executable rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T

MASKS = [
    ("strip 함수는 양쪽 공백을 지운다.", "strip", "____ 함수는 양쪽 공백을 지운다.", 1),
    ("____ 함수를 쓰면 strip 결과가 새 문자열로 나온다.", "strip", "____ 함수를 쓰면 ____ 결과가 새 문자열로 나온다.", 2),
    ("____ 함수는 공백을 지운다.", " ", None, "정답이 비어 있음"),
    ("____ 함수는 공백을 지운다.", "가" * 31, None, "정답이 너무 김(31자)"),
    (" ____ ", "strip", None, "문제에 빈칸 말고 내용이 없음"),
    ("strip은 양쪽 공백을 ________.", "지운다", "strip은 양쪽 공백을 ____.", 1),
    ("___ 함수는 양쪽 공백을 지운다.", "strip", "____ 함수는 양쪽 공백을 지운다.", 1),
    ("__init__ 메서드는 snake_case 이름의 ____ 변수를 만든다.", "인스턴스", "__init__ 메서드는 snake_case 이름의 ____ 변수를 만든다.", 1),
    ("___private 변수는 ____ 로 표시한다.", "관례", "___private 변수는 ____ 로 표시한다.", 1),
    ("a___b 는 ____ 이다.", "관례", "a___b 는 ____ 이다.", 1),
    ("__init___ 는 ____ 이다.", "관례", "__init___ 는 ____ 이다.", 1),
    ("딕셔너리 ____에서 '____'의 Value를 얻기 위해 ____['____']을 사용한다.", "a", None, "LLM이 쓴 빈칸이 4개, 빈칸은 하나만 쓸 것"),
    ("________ 함수는 공백을 ______.", "strip", None, "LLM이 쓴 빈칸이 2개, 빈칸은 하나만 쓸 것"),
    ("print와 int는 다르다 \\E.", "int", "print와 ____는 다르다 \\E.", 1),
    ("없는 말.", "strip", None, "정답이 문장에 없음: strip"),
    ("strip.", "strip", None, "정답이 문장 전체"),
]


def test_make_question(spark):
    rows = spark.createDataFrame([(k, t, a) for k, (t, a, _, _) in enumerate(MASKS)], "k int, t string, a string")
    found = rows.select("k", T.make_question(F.col("t"), F.col("a")).alias("q")).orderBy("k").collect()
    for row, (_, _, question, rest) in zip(found, MASKS, strict=True):
        assert (row["q"]["question"], row["q"]["blanks"] if question else row["q"]["error"]) == (question, rest)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("question", "words"), [("튜플의 append 메서드는 어떻게 써?", "튜플 append 메서드"), ("왜?", "왜?"), ("정의 결과를 순회하려면", "정의 결과")])
def test_question_keywords(spark, question, words):
    assert one(spark, T.question_keywords(F.col("q")), q=question) == words


@pytest.mark.parametrize(("concept", "tokens"), [("if문", ["if"]), ("튜플 자료형", ["튜플"]), ("불리언", ["불리언", "boolean", "bool"]), ("값을", ["값을"])])
def test_concept_tokens(spark, concept, tokens):
    assert one(spark, T.concept_tokens(F.col("c")), c=concept) == tokens


def test_search_query(spark):
    assert one(spark, T.search_query(F.col("c")), c="불리언") == "불리언 (boolean, bool)"
    assert one(spark, T.search_query(F.col("c")), c="튜플") == "튜플"


FACT = "리스트의 원소는 순서가 있고 인덱스로 꺼내 쓸 수 있으며 값을 바꿀 수 있는 자료형으로 다룬다."
UNFIT = [
    (FACT, False, None),
    (FACT, True, "코드 포함"),
    ("이번에는 함수를 알아보자. " + FACT, False, "도입·예고(첫 문장)"),
    ("앞에서 배웠습니다. " + FACT, False, "회고(첫 문장)"),
    ("함수를 알아보자. 함수란 입력을 받아 결과를 돌려주는 것을 말한다. " + FACT, False, None),
    ("짧다.", False, "내용 부족"),
    ("마치 상자 같다. 매력이 있다. 흥미롭다.", False, "평가·감상"),
    ("마치 상자 같다. 매력이 있다.", False, "비유"),
]


@pytest.mark.parametrize(("text", "code", "reason"), UNFIT)
def test_unfit_reason(spark, text, code, reason):
    assert one(spark, T.unfit_reason(F.col("t"), F.col("c")), t=text, c=code) == reason


def test_grade(spark):
    rows = [("ox", True, None, None, "ㅇ", True), ("ox", True, None, None, "틀림", False), ("ox", True, None, None, "글쎄", None), ("mcq", None, 2, None, " 3 ", True), ("mcq", None, 2, None, "2", False), ("short", None, None, ["strip()"], "`.Strip`", True), ("blank", None, None, ["a"], "b", None), ("blank", None, None, ["a"], " ", False)]
    df = spark.createDataFrame(rows, "f string, o boolean, i int, a array<string>, r string, want boolean")
    for row in df.select("want", T.grade(F.col("f"), F.col("o"), F.col("i"), F.col("a"), F.col("r")).alias("got")).collect():
        assert row["got"] == row["want"]


def test_exposed_choices_and_marks(spark):
    assert one(spark, T.exposed(F.col("a"), F.col("t")), a="str.strip()", t="lstrip과 strip은") is True
    assert one(spark, T.exposed(F.col("a"), F.col("t")), a="str.strip()", t="lstrip은") is False
    assert one(spark, T.exposed(F.col("a"), F.col("t")), a="거짓", t="거짓") is False
    assert one(spark, T.strip_choice_prefixes(F.array(F.lit("A) x"), F.lit("② y")))) == ["x", "y"]
    assert one(spark, T.strip_choice_prefixes(F.array(F.lit("A) x"), F.lit("y")))) == ["A) x", "y"]
    assert one(spark, T.cited_numbers(F.lit("see [2], [10] and [2]"))) == [2, 10]
    assert one(spark, T.highlighted(F.lit("a b b"), F.lit("b"))) == "a **b** b"
    assert one(spark, T.contains(F.lit("그는 “좋다” 고 했다."), F.lit('"좋다"고 했다!'))) is True


def test_registered_functions(spark):
    from pagemill.functions.registry import register

    register(spark)
    assert spark.sql("SELECT squash('a  b.') AS s, cosine_distance(array(1D, 0D), array(0D, 2D)) AS d, short_penalty('') AS p").first().asDict() == {"s": "ab", "d": 1.0, "p": 0.1}
