"""Evaluation runs: checks of generated blanks, choice among candidates, book filter check, summaries."""

from __future__ import annotations

import builtins
import keyword
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MADE, NOT_MADE, FAILED, SKIPPED = "출제", "출제 못함", "오류", "건너뜀"
# Bounds, reasons of refusal, and below the cells and messages of the results, as their readers expect them.
MAX_TRIES, MAX_ROUNDS, MIN_HANGUL = 3, 2, 5
REJECT_REASONS = ["정보 없음", "비유", "다른 언어", "추상적 주장", "개념 불일치"]
#: Names of the language and of its basic types, which are no examples' own.
PYTHON_NAMES = sorted({*keyword.kwlist, *dir(builtins)})
API_NAMES = sorted({n for t in (str, bytes, list, tuple, dict, set, frozenset, int, float, complex, bool, object) for n in dir(t)})


def cell_status(cell: Column) -> Column:
    c = F.coalesce(cell, F.lit(""))
    return F.when(F.length(c) == 0, SKIPPED).when(c.startswith("(출제 못함") | c.startswith("(거부"), NOT_MADE).when(c.startswith("(오류"), FAILED).when(c.startswith("(건너뜀"), SKIPPED).otherwise(MADE)


def one_word_error(answer: Column) -> Column:
    n = F.size(F.filter(F.split(answer, "(?U)\\s+"), lambda w: F.length(w) > 0))
    return F.when(n != 1, F.concat(F.lit("정답이 한 단어가 아님: "), answer)).when(answer.rlike("(다|요)$"), F.concat(F.lit("정답이 서술어로 끝남: "), answer))


def korean_error(question: Column) -> Column:
    return F.when(F.regexp_count(question, F.lit("[가-힣]")) < MIN_HANGUL, F.concat(F.lit("한국어 문제가 아님: "), F.substring(question, 1, 40)))


def korean_term_error(answer: Column, text: Column) -> Column:
    """A Latin answer must stand in the prose, and not beside a Korean term it explains."""
    latin = answer.rlike("^[A-Za-z]+$")
    beside = F.regexp_like(text, F.concat(F.lit("(?i)[가-힣]\\s*\\(\\s*"), T.quoted(answer), F.lit("\\s*\\)")))
    prose = F.regexp_replace(text, "(?s)```.*?```", "")
    stands = F.regexp_like(prose, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), T.quoted(answer), F.lit("(?![A-Za-z0-9_])")))
    return F.when(latin & beside, F.concat(F.lit("한글 용어가 있는데 영어 정답: "), answer)).when(latin & ~stands, F.concat(F.lit("영어 정답이 코드에만 있음: "), answer))


def defined_name_error(question: Column, answer: Column, text: Column) -> Column:
    """Names that the paragraph's code makes, or that look like an example's, may not be asked for."""
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    of = lambda xs: F.array(*map(F.lit, xs))
    own = F.array_except(names(F.concat_ws(" ", question, answer)), of(PYTHON_NAMES))
    made = F.filter(own, lambda n: F.regexp_like(text, F.concat(F.lit("(?U)\\b"), n, F.lit("\\s*=(?!=)|\\b(def|class)\\s+"), n, F.lit("\\b|\\bfor\\s+"), n, F.lit("\\s+in\\b"))))
    snake = F.filter(F.array_except(names(question), of(sorted({*PYTHON_NAMES, *API_NAMES}))), lambda n: F.regexp_replace(n, "^_+|_+$", "").contains("_") & ~n.startswith("__"))
    return F.when(F.size(made) > 0, F.concat(F.lit("문단 코드에서 만든 이름이 나옴: "), F.get(F.array_sort(made), F.lit(0)))).when(F.size(snake) > 0, F.concat(F.lit("예제용 이름이 문제에 나옴: "), F.get(F.array_sort(snake), F.lit(0))))


def checked_blank(question: Column, answer: Column, text: Column) -> Column:
    """struct(question, error): the masked question, or the first check that fails."""
    masked = T.make_question(question, answer)
    error = F.coalesce(one_word_error(answer), korean_error(question), korean_term_error(answer, text), defined_name_error(question, answer, text), masked["error"], F.when(~T.contains(text, answer), "정답이 핵심 문단에 없음"))
    return F.struct(F.when(error.isNull(), masked["question"]).alias("question"), error.alias("error"))


def solver_verdict(determinable: Column, got: Column, gold: Column, judged_same: Column) -> Column:
    """struct(ok, exact, why) of a solver's answer."""
    got = T.strip(F.coalesce(got, F.lit("")))
    bare = lambda c: F.lower(F.regexp_replace(c, "(?U)\\s+", ""))
    unsure = ~F.coalesce(determinable, F.lit(False)) | (F.length(got) == 0)
    exact = ~unsure & (bare(got) == bare(gold))
    ok = exact | (~unsure & F.coalesce(judged_same, F.lit(False)))
    why = F.when(unsure, "문제만으로 정답을 정할 수 없음").when(~ok, F.concat(F.lit("풀이 답 불일치: "), got)).otherwise("")
    return F.struct(ok.alias("ok"), exact.alias("exact"), why.alias("why"))


def best_candidates(tries: DataFrame, per_round: int = MAX_TRIES, rounds: int = MAX_ROUNDS) -> DataFrame:
    """tries (case_id, rank, passed, exact, blanks, ...) -> each case's choice.

    Candidates come in rounds of per_round by rank; in the first round where one passes, exact answers come first, then
    fewer blanks, then the better rank.
    """
    rounds_of = tries.withColumn("round", F.floor((F.col("rank") - 1) / per_round)).where((F.col("round") < rounds) & F.col("passed"))
    first = rounds_of.withColumn("_first", F.min("round").over(Window.partitionBy("case_id"))).where(F.col("round") == F.col("_first"))
    row = F.struct(*[c for c in tries.columns if c != "case_id"])
    return first.groupBy("case_id").agg(F.min_by(row, F.struct((~F.col("exact")).alias("inexact"), "blanks", "rank")).alias("b")).select("case_id", "b.*")


def filter_check(cases: DataFrame, found: DataFrame, free: DataFrame) -> DataFrame:
    """cases (id, book_id), found (id, book_id of filtered hits), free (id, nearness, book_id of the unfiltered top) ->
    per case: books found, whether only its own, and how many of the unfiltered are of other books, and the first one's."""
    case = cases.select("id", F.col("book_id").alias("case_book"))
    mine = found.groupBy("id").agg(F.array_sort(F.collect_set("book_id")).alias("books"))
    other = free.join(case, "id").groupBy("id").agg(F.count("*").alias("n_free"), F.count_if(F.col("book_id") != F.col("case_book")).alias("n_other"), F.max_by(F.col("book_id") != F.col("case_book"), -F.col("nearness")).alias("first_other"))
    rows = case.join(mine, "id", "left").join(other, "id", "left")
    return rows.withColumn("books", F.coalesce("books", F.array().cast("array<long>"))).withColumn("passed", F.size(F.array_except("books", F.array("case_book"))) == 0)


def filter_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n_cases"), F.count_if("first_other").alias("n_first_other"), F.sum("n_other").alias("n_other"), F.sum("n_free").alias("n_free"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("id")))).alias("failed_ids"))


def status_counts(rows: DataFrame, cell: str) -> DataFrame:
    return rows.groupBy(cell_status(F.col(cell)).alias("status")).agg(F.count("*").alias("n"))


def reject_shares(rejects: DataFrame, n_made: int | Column = 0) -> DataFrame:
    """rejects (reason) -> n and share of all attempts, the made ones included."""
    kind = F.regexp_extract("reason", "^[^(]*", 0)
    counts = rejects.groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy()) + n_made
    return counts.withColumn("share", F.col("n") / total)


def usage_summary(rows: DataFrame) -> DataFrame:
    """rows (calls, chars, status, length) of the cases -> totals, means per case, lengths of the made ones' paragraphs."""
    made = F.when(F.col("status") == MADE, F.col("length"))
    return rows.agg(F.sum("calls").alias("calls"), F.sum("chars").alias("chars"), F.avg("calls").alias("calls_per_case"), F.avg(made).alias("mean_length"), F.min(made).alias("min_length"), F.max(made).alias("max_length"))


def unfinished(cases: DataFrame, results: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Cases without a result, or with an error in one of its cells."""
    good = ~F.greatest(*[(cell_status(F.col(c)) == FAILED).cast("int") for c in cells], F.lit(0)).cast("boolean")
    return cases.join(results.where(good).select("id"), "id", "left_anti")


def book_titles(rows: DataFrame) -> DataFrame:
    """The last title that is not null, by page, of each book."""
    return rows.where("book_title is not null and book_id is not null").groupBy("book_id").agg(F.max_by("book_title", "page_id").alias("book_title"))
