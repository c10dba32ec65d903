"""Retrieval, vector table, quizzes, evaluation, files and the stream, on small cases by hand."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import providers
from pagemill.operators import evaluation, index, quiz, refine, retrieval, units, vectors
from pagemill.sources import files
from pagemill.streaming.ingestion import ingest_stream


def test_top_n_is_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(333, 8))
    m[10] = m[20] = m[5]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<double>").repartition(5)
    q = df.where("id % 50 = 5").select(F.col("id").alias("qid"), "vector")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in retrieval.top_n(q, df, 7).collect():
        got.setdefault(r["qid"], []).append((round(r["distance"], 9), r["id"]))
    for k, rows in got.items():
        want = sorted((round(1 - float(unit[k] @ unit[i]), 9), i) for i in range(len(m)))[:7]
        assert sorted(rows) == want
    assert sorted(got) == list(range(5, 333, 50))


def test_rank_by_score_cut_by_its_distance(spark):
    long, short = "x" * 80, "x"
    rows = [(1, 1, 0.30, short), (1, 2, 0.35, long), (1, 3, 0.49, long), (1, 4, 0.51, long)]
    hits = retrieval.ranked(retrieval.scored(spark.createDataFrame(rows, "qid long, id long, distance double, text string")))
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [2, 1, 3, 4]
    cut = retrieval.numbered(retrieval.margin_cut(hits, 0.9, 0.15), 2)
    assert [(r["id"], r["no"]) for r in cut.orderBy("no").collect()] == [(2, 1), (1, 2)]
    assert {r["id"] for r in retrieval.margin_cut(hits, 0.9, 0.15).collect()} == {1, 2, 3}


def test_gates(spark):
    rows = [(1, 1, ["튜플 다루기"]), (1, 2, ["집합"]), (2, 3, ["집합"]), (2, 4, ["집합"])]
    hits = spark.createDataFrame(rows, "qid long, id long, path array<string>").withColumn("concept", F.lit("튜플 자료형"))
    kept = retrieval.page_gate(hits, retrieval.path_matches(F.col("concept"), F.col("path")))
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4]


def test_find_and_validity(spark):
    units_ = spark.createDataFrame([(1, "a" * 90, ["p"], "h1"), (2, "b" * 90, ["p"], "h2"), (3, "c" * 90, ["p"], "h3")], "id long, text string, path array<string>, embed_hash string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2]), (4, [1.0, 0.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(7, "p thing", [1.0, 0.0])], "qid long, concept string, vector array<double>")
    stored = spark.createDataFrame([(1, "h1"), (2, "old"), (3, "h3")], "id long, embed_hash string")
    out = spark.createDataFrame([(3,)], "id long")
    assert [r["id"] for r in retrieval.find(q, v, units_, stored=stored, exclude=out).collect()] == [1]
    assert [r["id"] for r in retrieval.find(q, v, units_, n=2).orderBy("rank").collect()] == [1]  # the limit comes before the join
    assert [r["id"] for r in retrieval.retrieve(q, v, units_, k=2).orderBy("no").collect()] == [1, 2]
    rows = retrieval.in_page(spark.createDataFrame([(1, 5, [1.0, 0.0])], "qid long, page_id long, vector array<double>"), spark.createDataFrame([(1, 5, [0.5, 0.5]), (2, 5, [0.6, 0.1]), (3, 6, [1.0, 0.0])], "id long, page_id long, vector array<double>"))
    assert [(r["id"], r["score"]) for r in rows.orderBy("rank").collect()] == [(2, 0.6), (1, 0.5)]


def test_page_context(spark):
    def around(texts, a, b, limit):
        df = spark.createDataFrame([(texts, a, b)], "t array<string>, a int, b int")
        return df.select(retrieval.page_context(F.col("t"), F.col("a"), F.col("b"), limit, "<>").alias("c")).first()["c"]

    assert around(["aa", "", "core", "bb", "cc"], 2, 3, 100) == "aa\n<>\nbb\ncc"
    assert around(["aaaa", "core", "bb", "cccc"], 1, 2, 5) == "...(앞부분 생략)\n<>\nbb\n...(뒷부분 생략)"


def test_vector_table(spark):
    stored = spark.createDataFrame([("a", "1", [1.0]), ("b", "2", [2.0]), ("z", "9", [9.0])], "unit_id string, embed_hash string, embedding array<float>")
    new = spark.createDataFrame([("a", "1", "t1"), ("b", "3", "t3"), ("c", "2", "t2")], "unit_id string, embed_hash string, embed_text string")
    assert {r["unit_id"]: r["status"] for r in index.diff(stored, new).collect()} == {"a": "same", "b": "changed", "c": "new", "z": "stale"}
    made = index.embedded(new, stored, lambda texts: [[float(len(t)) * 10] for t in texts])
    assert {r["unit_id"]: r["embedding"] for r in made.collect()} == {"a": [1.0], "b": [20.0], "c": [2.0]}
    after = index.upserted(stored, made)
    assert {r["unit_id"]: r["embed_hash"] for r in after.collect()} == {"a": "1", "b": "3", "c": "2", "z": "9"}
    assert {r["status"] for r in index.diff(after, new).where("unit_id <> 'z'").collect()} == {"same"}


def question(**more):
    return json.dumps({"reject_reason": "없음", "evidence": "리스트는 순서가 있는 자료형이다", **more}, ensure_ascii=False)


TEXT = "파이썬의 리스트는 순서가 있는 자료형이다. append로 더한다."
REPLIES = [
    ("ox", "nothing", "format error"), ("ox", question(statement="s", answer=True), "ok"), ("ox", question(statement=" ", answer=True), "invalid"), ("ox", question(statement="s", answer="true"), "invalid"),
    ("ox", json.dumps({"reject_reason": "비유"}), "rejected"), ("ox", json.dumps({"statement": "s", "answer": False, "evidence": "없는 말을 길게 적었다"}), "unverified"),
    ("blank", question(question="____는 순서가 있는 자료형이다.", answer="리스트"), "ok"), ("blank", question(question="____와 ____", answer="리스트"), "unverified"), ("blank", question(question="____는 더한다.", answer="튜플"), "unverified"),
    ("short", question(question="더하는 메서드는?", answer="append()", accepted=["append"]), "ok"), ("short", question(question="append는?", answer="list.append()"), "invalid"), ("short", question(question="무엇?", answer="pop"), "unverified"),
    ("mcq", question(question="q", choices=["a", "b", "c", "d"], choice_notes=["1", "2", "3", "4"], answer_index=3), "ok"), ("mcq", question(question="q", choices=["a", "b", "c"], choice_notes=["1", "2", "3"], answer_index=1), "invalid"),
    ("mcq", question(question="q", choices=["a", "a", "c", "d"], choice_notes=["1", "2", "3", "4"], answer_index=1), "invalid"), ("mcq", question(question="q", choices=["a", "a ", "c", "d"], choice_notes=["1", "2", "3", "4"], answer_index=True), "invalid"),
    ("mcq", question(question="q", choices=["a", "a ", "c", "d"], choice_notes=["1", "2", "3", "4"], answer_index=4), "invalid"), ("mcq", question(question="q", choices=["a", "b", "c", "d"], choice_notes=["1"], answer_index=0), "invalid"),
]


def test_questions(spark):
    df = spark.createDataFrame([(k, f, r, TEXT) for k, (f, r, _) in enumerate(REPLIES)], "k int, fmt string, reply string, text string")
    rows = quiz.judged(quiz.questions(df)).orderBy("k").collect()
    for r in rows:
        assert r["status"] == REPLIES[r["k"]][2], (r["k"], r["reason"])


def test_shuffle_and_normal_form(spark):
    df = spark.createDataFrame([(k, ["A) a", "B) b", "C) c", "D) d"], ["na", "nb", "nc", "nd"], 2) for k in range(20)], "k int, c array<string>, n array<string>, i int")
    rows = df.select(quiz.shuffled(F.col("c"), F.col("n"), F.col("i"), F.col("k")).alias("s")).collect()
    assert all(r["s"]["choices"][r["s"]["answer_index"]] == "C) c" and [x[-1] for x in r["s"]["choices"]] == [x[-1] for x in r["s"]["notes"]] for r in rows)
    assert len({tuple(r["s"]["choices"]) for r in rows}) > 3
    q = quiz.questions(spark.createDataFrame([(question(skill="x", concept=" Ab ", accepted=["b", "a", "b"], answer="a"),)], "reply string"))
    n = q.select(quiz.normal_form(F.col("q"), F.col("answer")).alias("n")).first()["n"]
    assert (n["skill"], n["concept"], n["accepted"]) == ("", "ab", ["a", "b"])
    assert [r["f"] for r in spark.createDataFrame([("ox, mcq,ox",), ("ox,no",)], "x string").select(quiz.parsed_formats(F.col("x")).alias("f")).collect()] == [["ox", "mcq"], None]


def test_quiz_session(spark):
    rows = [("s", ["c", "p"], o, k, u, "t", None) for k, (o, u) in enumerate([("c", "u1"), ("c", "u2"), ("p", "u3")])]
    df = spark.createDataFrame(rows, "session string, origins array<string>, origin string, place int, unit_id string, text string, chosen string")

    def ask(fmt, cand, previous):
        return (None, "거부(비유)") if cand["unit_id"] == "u1" else ({"question": f"{cand['unit_id']}-{fmt}-{len(previous)}"}, "")

    made = quiz.make_quiz(df, ["ox", "blank"], ask).orderBy("slot").collect()
    assert [(r["slot"], r["unit_id"], r["question"]) for r in made] == [(0, "u2", "u2-ox-0"), (1, "u3", "u3-blank-1")]
    slots = spark.range(1, 9).select(quiz.slot_origins(F.col("id").cast("int"), F.lit(2), F.col("id")).alias("o")).collect()
    assert [sum(x == quiz.SAME_PAGE for x in r["o"]) for r in slots] == [0, 1, 1, 1, 2, 2, 2, 2]


def test_page_pool(spark):
    cited = spark.createDataFrame([("s", "u1", 1)], "session string, unit_id string, page_id long")
    hits = spark.createDataFrame([("s", f"u{k}", 1 if k < 9 else 2, "x" * (200 if k != 3 else 10), k / 10) for k in range(1, 11)], "session string, unit_id string, page_id long, text string, score double")
    rows = [r["unit_id"] for r in quiz.page_pool(cited, hits).orderBy("place").collect()]
    assert set(rows[:5]) == {"u8", "u7", "u6", "u5", "u4"} and rows[5:] == ["u2"]


def test_replies_keep_errors(spark):
    def chat(messages):
        if messages[0]["content"] == "bad":
            raise providers.ProviderError("no")
        return messages[0]["content"].upper()

    df = spark.createDataFrame([("1", [("user", "hi")]), ("2", [("user", "bad")])], "key string, messages array<struct<role:string,content:string>>")
    assert {r["key"]: (r["reply"], r["error"]) for r in quiz.replies_of(df, chat).collect()} == {"1": ("HI", None), "2": (None, "ProviderError: no")}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.ProviderError("busy", retry=True, after=99)
        return "ok"

    waits = []
    assert providers.retried(flaky, sleep=waits.append) == "ok" and waits == [30.0, 30.0]
    with pytest.raises(ValueError):
        providers.provider("none")
    a, b = providers.hashing_embed(["same words", "same words"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6




def test_blank_checks(spark):
    rows = [
        ("리스트는 ____ 자료형이다", "두 말", "두 말", "정답이 한 단어가 아님: 두 말"), ("리스트는 값을 ____ 수", "없다", "없다", "정답이 서술어로 끝남: 없다"), ("only ____ here", "리스트", "리스트", "한국어 문제가 아님: only ____ here"),
        ("리스트는 ____ 이다 그렇다", "variable", "변수(variable)는", "한글 용어가 있는데 영어 정답: variable"), ("리스트는 ____ 이다 그렇다", "foo", "```python\nfoo\n```", "영어 정답이 코드에만 있음: foo"),
        ("리스트는 total 과 ____ 이다", "합계", "total = 1 합계", "문단 코드에서 만든 이름이 나옴: total"), ("num_accounts 는 ____ 이다 그렇다", "개수", "개수", "예제용 이름이 문제에 나옴: num_accounts"),
        ("리스트는 ____ 이다 그렇다", "순서", "다른 말", "정답이 핵심 문단에 없음"), ("리스트는 ____ 이다 그렇다", "순서", "순서가 있다", None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, q string, a string, t string, want string")
    for r in df.select("want", evaluation.checked_blank(F.col("q"), F.col("a"), F.col("t")).alias("c")).collect():
        assert r["c"]["error"] == r["want"]


def test_evaluation_tables(spark):
    df = spark.createDataFrame([("",), ("(거부: x)",), ("(오류: x)",), ("(건너뜀: x)",), ("문제",), (None,)], "c string")
    assert {r["status"]: r["n"] for r in evaluation.status_counts(df, "c").collect()} == {"건너뜀": 3, "출제 못함": 1, "오류": 1, "출제": 1}
    rejects = spark.createDataFrame([("비유",), ("검증 실패(x)",), ("검증 실패(y)",)], "reason string")
    assert {r["reason"]: (r["n"], r["share"]) for r in evaluation.reject_shares(rejects, 1).collect()} == {"비유": (1, 0.25), "검증 실패": (2, 0.5)}
    v = spark.createDataFrame([(True, "A b", "a B", False), (True, "x", "y", True), (False, "x", "x", True), (True, "x", "y", None)], "d boolean, got string, gold string, j boolean")
    assert [tuple(r["v"])[:2] for r in v.select(evaluation.solver_verdict(F.col("d"), F.col("got"), F.col("gold"), F.col("j")).alias("v")).collect()] == [(True, True), (True, False), (False, False), (False, False)]
    tries = spark.createDataFrame([("c", 1, False, True, 1), ("c", 4, True, True, 2), ("c", 5, True, True, 1), ("c", 6, True, False, 0), ("c", 7, True, True, 0)], "case_id string, rank int, passed boolean, exact boolean, blanks int")
    assert evaluation.best_candidates(tries).first()["rank"] == 5
    cases = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    results = spark.createDataFrame([("1", "ok", ""), ("2", "(오류: x)", "")], "id string, a string, b string")
    assert sorted(r["id"] for r in evaluation.unfinished(cases, results, ["a", "b"]).collect()) == ["2", "3"]
    usage = spark.createDataFrame([(2, 10, "출제", 100), (4, 30, "오류", 7)], "calls int, chars int, status string, length int")
    assert tuple(evaluation.usage_summary(usage).first()) == (6, 40, 3.0, 100.0, 100, 100)
    checked = spark.createDataFrame([("1", True, True, 2, 5), ("2", False, False, 0, 5)], "id string, passed boolean, first_other boolean, n_other int, n_free int")
    assert tuple(evaluation.filter_summary(checked).first()) == (1, 2, 1, 2, 10, ["2"])


def test_vectors(spark):
    df = spark.createDataFrame([(2, [0.0, 2.0, 0.05]), (1, [3.0, 4.0, 0.0])], "id long, v array<double>")
    row = vectors.stats(df, F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0))).where("id = 1").first()
    assert (row["norm"], row["min"], row["max"], row["n_large"], row["cosine"]) == (5.0, 0.0, 4.0, 2, 1.0)
    assert [r["dim"] for r in vectors.dimensions(df).orderBy("place").collect()] == [0, 1, 2]
    assert [r["id"] for r in vectors.selected(df, where=F.lit(True)).collect()] == [1, 2]
    assert vectors.wide(df, 3).columns == ["id", "d0", "d1", "d2"]
    assert spark.range(1).select(vectors.snippet(F.lit("head\nbody  text"))).first()[0] == "body text"
    assert len(vectors.plane(df.unionByName(df.withColumn("id", F.col("id") + 5))).collect()) == 4


def test_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": 2, "order": 1}\nbroken\n{"x": 1}\n{"id": 1}\n', encoding="utf-8")
    path = str(tmp_path / "p.jsonl")
    rows, bad = files.json_lines(spark, path, "id long")
    assert sorted(r["id"] for r in rows.where("id is not null").collect()) == [1, 2] and [r["value"] for r in bad.collect()] == ["broken"]
    assert sorted(r["id"] for r in files.done_ids(spark, path).collect()) == [1, 2]
    assert [r["value"] for r in files.without(spark, path, [2]).collect()] == ["broken", '{"x": 1}', '{"id": 1}']
    (tmp_path / "c.csv").write_text("﻿id,book_id,개념\n1,2,튜플\n ,3,x\n", encoding="utf-8")
    assert [tuple(r) for r in files.csv_cases(spark, str(tmp_path / "c.csv")).collect()] == [("1", "2", "튜플")]
    for book, text in (("book2", "b"), ("book1", "a")):
        (tmp_path / book / "raw").mkdir(parents=True)
        (tmp_path / book / "raw" / "7.html").write_text(text)
    assert [tuple(r) for r in files.cached_pages(spark, str(tmp_path)).collect()] == [(7, "a")]
    assert [r[0] for r in files.book_ids(spark.createDataFrame([("/d/book12/x",), ("/d/unbound/x",), ("/d/book3",)], "path string")).collect()] == [3, 12]
    (tmp_path / "r.json").write_text('{"book1": {"exclude_ids": [4]}}')
    assert files.rules(spark, str(tmp_path / "r.json"), "book1") == {"exclude_titles": [], "exclude_ids": [4], "include_ids": []}
    with pytest.raises(ValueError):
        files.rules(spark, path, "book1")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    out = str(tmp_path / "v")
    assert files.written_if_changed(df, out) and not files.written_if_changed(df.orderBy(F.desc("id")), out) and files.written_if_changed(df.limit(1), out)
    assert spark.read.parquet(out).select("version").distinct().count() == 2
    assert df.where(files.all_of(id=2, t=None)).count() == 1 and df.where(files.all_of()).count() == 2


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    parse = lambda b: refine.parsed_pages(b, selector="article").select("page_id", F.size("blocks").alias("n"))

    def arrive(n, rows):
        spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.mode("append").parquet(f"file://{source}")
        pages = spark.readStream.schema("page_id long, html string").parquet(f"file://{source}")
        ingest_stream(pages, out, f"file://{tmp_path}/check", parse).awaitTermination(120)
        return sorted((r["page_id"], r["n"]) for r in spark.read.parquet(out).collect())

    assert arrive(1, [(1, "<article><p>a</p></article>"), (1, "<article><p>a</p></article>"), (2, "<p>x</p>")]) == [(1, 1), (2, 0)]
    assert arrive(2, [(2, "<article><p>b</p></article>"), (3, "<article><p>c</p><p>d</p></article>")]) == [(1, 1), (2, 0), (3, 2)]


def test_metadata(spark):
    df = spark.createDataFrame([("u", "c", None, None, ["a", "b"], "s", "h")], "unit_id string, chunk_id string, page_id long, book_id long, path array<string>, section string, embed_hash string")
    row = index.metadata(df, "unbound", "m").first()
    assert (row["page_id"], row["book_id"], row["path"], row["source_dir"]) == (-1, -1, "a > b", "unbound")
    assert units.MIN_UNIT_CHARS == 30


def test_build(spark, tmp_path):
    from pagemill.plans import build as b

    html = "<article><h2>Part</h2><p>A first paragraph that is long enough to be kept.</p><p>{}</p></article>"
    schema = "page_id long, title string, book_id long, book_title string, breadcrumb array<string>, html string"
    pages = lambda text: spark.createDataFrame([(1, "T", 1, "B", ["B", "T"], html.format(text)), (2, "Preface", 1, "B", ["B"], html.format("x"))], schema)
    root, calls = f"file://{tmp_path}", {"selector": "article", "include_ids": [1]}
    log = f"{tmp_path}/asked"

    def embed(texts):
        with open(log, "a") as f:
            f.writelines("x\n" for _ in texts)
        return providers.hashing_embed(texts)

    asked = lambda: len(open(log).readlines())  # noqa: E731, SIM115
    first = b.build(spark, pages("more " * 120), root, embed, **calls)
    assert first["refine"]["chunks"] and first["refine"]["excluded"] and first["embed"]["new"] == 2
    assert first["refine"]["no_body"] == 0 and first["refine"]["code_kinds"] == {} and asked() == 2
    again = b.build(spark, pages("more " * 120), root, embed, **calls)
    assert again["refine"]["up_to_date"] and again["embed"] == {"same": 2, "too_long": 0, "seconds": again["embed"]["seconds"]}
    third = b.build(spark, pages("less " * 120), root, embed, **calls)
    assert third["embed"]["changed"] == 1 and third["embed"]["same"] == 1 and asked() == 3  # a changed text is embedded once
    forced = b.build(spark, pages("less " * 120), root, embed, last="refine", force=True, **calls)
    assert not forced["refine"]["chunks"]
    b.build(spark, pages("less " * 120), root, embed, first="embed", rebuild=True)
    assert asked() == 3
    assert b.latest(spark, f"{root}/vectors").count() == 2
    rows = spark.createDataFrame([("a", "one two three"), ("b", "one")], "unit_id string, embed_text string")
    assert [r["unit_id"] for r in index.too_long(rows, providers.count_tokens, 2).collect()] == ["a"]
    with pytest.raises(ValueError):
        b.stage_slice("embed", "refine")


def test_prompts_and_replies(spark):
    replies = spark.createDataFrame([("s", 'so {"formats": [{"no": 1, "format": "ox"}, {"no": 9, "format": "ox"}, {"no": 2, "format": "no"}, {"no": 1, "format": "mcq"}]}', 3), ("t", "nothing", 3)], "session string, reply string, n_candidates int")
    assert [tuple(r) for r in quiz.chosen_formats(replies, ["ox", "mcq"]).collect()] == [("s", 1, "mcq")]
    rows = spark.createDataFrame([("s", 2, "p", "b"), ("s", 1, "p", "a")], "session string, no int, path string, text string")
    assert quiz.source_listing(rows).first()["listing"] == "[1] p\na\n\n[2] p\nb"
    kinds = spark.createDataFrame([("429 slow",), ("limit of tokens per day",), ("json_validate_failed",), ("x",), (None,)], "e string").select(quiz.error_class(F.col("e")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["rate limit", "daily limit", "schema", "other", None]
    scores = spark.createDataFrame([("s", True), ("s", None), ("s", False)], "session string, result boolean")
    assert tuple(quiz.score_summary(scores).first()) == ("s", 3, 2, 1)
    text = spark.range(1).select(quiz.quiz_prompt(F.lit("T"), F.lit("Q"), F.lit("P"), F.array(F.lit("x")), F.lit("O/X"))).first()[0]
    assert "[이미 낸 문제]\n- x" in text and text.endswith("O/X 문제 1개를 만들어.")
