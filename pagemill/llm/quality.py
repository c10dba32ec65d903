"""Quality rules, line first: lines that fail a rule go, then documents that lose too much; DataFrame operations only.

Everything is computed within the row, without a shuffle. Words in repeated three-word windows are found by sorting the
windows' hashes with their places, so that a text of any length costs n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, boxed, let, unboxed, word_list

#: Parameters of the line rules. A line fails if any holds.
SEPARATORS = r"[|»]"  # navigation: three separators or more, and one for every five words
BOILERPLATE = r"(?i)all rights reserved|licensed under|released under|general public license|terms of (use|service)|privacy policy|cookie|enable javascript|click here|subscribe|lorem ipsum"
ENDS_WELL = "[.!?:;…][\"')\\]”’»]*\\s*$"  # punctuation: a line of fewer than eight words must end with a mark
SHOUTS = r"!!"  # one for every four words
MARKS = r"[#*$%&<>{}~^=@\\]"  # six or more, and one for every two words
#: A document goes if its failed lines hold more than this share of its words.
MAX_LOST = 0.3


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of n words fails a rule. A blank line never does."""
    separators, marks = count_of(line, SEPARATORS), count_of(line, MARKS)
    navigation = let(separators, lambda k: (k >= 3) & (k * 5 >= n))
    marked = let(marks, lambda k: (k >= 6) & (k * 2 >= n))
    return (n > 0) & (navigation | marked | (count_of(line, SHOUTS) * 4 >= n) | ((n < 8) & ~line.rlike(ENDS_WELL)) | line.rlike(BOILERPLATE))


def judged_lines(lines: Column) -> Column:
    """For each line the line, its words, and whether it fails."""
    return F.transform(lines, lambda line: let(count_of(line, WORD), lambda n: F.struct(line.alias("line"), n.alias("n"), line_fails(line, n).alias("fails"))))


def repeat_words(words: Column) -> Column:
    """How many words are in three-word windows that are found twice or more among the words."""

    def windows(w: Column) -> Column:
        hashed = lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), hashed))

    def places(s: Column) -> Column:
        twice = lambda x, j: F.coalesce((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, lambda w: let(windows(w), lambda s: let(places(s), covered)))


def verdict_of(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, clean_text, kept) of a text.

    Cases as in quality.
    """
    whole = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("repeated"))

    def of_lines(judged: Column) -> Column:
        real = F.transform(F.filter(judged, lambda x: x["n"] > 0), lambda x: x["line"])
        n_dup = let(real, lambda r: (F.size(r) - F.size(F.array_distinct(r))).cast("long"))
        lost = F.aggregate(judged, F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], x["n"]).otherwise(0))
        clean = F.array_join(F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
        return F.struct(n_dup.alias("n_dup"), lost.alias("lost"), clean.alias("clean"))

    def verdict(w: Column, q: Column) -> Column:
        failed = (w["n"] < 50) | (100 * w["repeated"] > 50 * w["n"])
        n_symbols = (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long")
        return F.struct(
            w["n"].alias("n_words"), w["chars"].alias("word_chars"), n_symbols.alias("n_symbols"), q["n_dup"].alias("n_dup_lines"), w["repeated"].alias("n_repeat_words"),
            failed.alias("base_failed"), q["lost"].alias("lost_words"), F.when(text.isNotNull(), q["clean"]).alias("clean_text"), (~failed & (q["lost"] <= MAX_LOST * w["n"])).alias("kept"),
        )

    lines = F.split(whole, "\n", -1)
    return let(let(word_list(text), of_words), lambda w: let(let(judged_lines(lines), of_lines), lambda q: verdict(w, q)))


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, q): docs as a struct, and the verdict on its text.

    The verdict is exploded out of an array of one, so that a filter on it is not pushed below it and computed once more.
    """
    boxes = boxed(docs, text=F.col(text_col))
    return boxes.select("row", F.explode_outer(F.array(verdict_of(F.col("text")))).alias("q"))


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
    clean_text and kept (in place of columns of docs with such names).

    clean_text is the text without the lines that fail (a blank line never fails). kept is false if base_failed (fewer
    than 50 words, or over half of them in repeated windows), or if the lost lines hold over MAX_LOST of the words. Null
    text has no words (so it is not kept) and stays null. Windows are compared by 64-bit hashes within a text. Every row
    is judged alone, so repeated rows and ids, null or not, do not matter; an empty table gives no rows.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "clean_text", "kept")
    return unboxed(judged(docs, text_col), docs.columns, **{n: F.col(f"q.{n}") for n in names})


def without_bad_lines(docs: DataFrame, text_col: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, with their clean text and (where there is such a column) its length; columns as in docs."""
    new = {text_col: F.col("q.clean_text")}
    if n_chars in docs.columns:
        new[n_chars] = F.length("q.clean_text").cast("long")
    return unboxed(judged(docs, text_col).where("q.kept"), docs.columns, **new)
