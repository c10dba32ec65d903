"""Exact dedup by progressive refinement: texts meet by length, then by a hash of their start, then by a hash of the whole.

Texts are equal if they are identical without their ASCII white space. The first scan measures lengths and hashes of
starts, and narrow rows are grouped by length; of lengths that occur twice or more, by length and start; only texts of
groups that are left over are read and hashed whole, in the second scan.

That scan has to know which texts are left over without shuffling any text: the keys of the groups are marked in a table
of bits whose size is bounded by BIT_WORDS (one bit for each key, sixteen bits a key as long as that fits), which is
broadcast. A text whose bit is set though its key is no such group is hashed in vain and then alone in its group, so
marks decide the cost and never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, unboxed, written

#: Characters that do not count, and how many of the others make the start of a text.
SPACE, START_CHARS = r"[\x20\x09-\x0D]", 64
#: Words of 64 bits in the table of marks, at most: 16 MB as rows.
BIT_WORDS = 1 << 20


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def start_of(text: Column) -> Column:
    """The first START_CHARS characters of the normalised text; the rest of the text is not looked at."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), rf"^(?:{SPACE}*+[^\x20\x09-\x0D]){{0,{START_CHARS}}}", 0)
    return F.regexp_replace(head, f"{SPACE}+", "")


def length_of(text: Column) -> Column:
    """Characters of the normalised text."""
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("long")


def start_key(text: Column) -> Column:
    """One number for length and start."""
    return F.xxhash64(length_of(text), start_of(text))


def _places(key: Column, words: int) -> tuple[Column, Column]:
    return F.pmod(key, F.lit(words)).alias("word"), F.pmod(F.shiftright(key, 40), F.lit(64)).cast("int").alias("bit")


def marks(texts: DataFrame) -> tuple[DataFrame, int]:
    """texts (text) -> ((word, bits), words): the table of bits, in which the keys of groups are marked that whole texts decide.

    A group by length, and then by length and start, is left over if it has two rows or more.
    """
    first = written(texts.select(length_of(F.col("text")).alias("length"), F.xxhash64(start_of(F.col("text"))).alias("start")), "starts")
    lengths = first.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    groups = first.join(lengths, "length", "left_semi").groupBy("length", "start").agg(F.count("*").alias("n")).where("n > 1")
    keys = written(groups.select("length", "start"), "start-groups")
    words = min(BIT_WORDS, max(64, keys.count() // 4))
    word, bit = _places(F.xxhash64("length", "start"), words)
    one = F.expr("shiftleft(1L, bit)")
    return written(keys.select(word, bit).groupBy("word").agg(F.bit_or(one).alias("bits")), "marks"), words


def hashed(rows: DataFrame, all_hashes: bool = False) -> DataFrame:
    """rows (..., text) with digest, the SHA-256 of the normalised text, where the text is left over (or for all), and left_over."""
    table, words = marks(rows.select("text"))
    word, bit = _places(F.xxhash64(length_of(F.col("text")), F.xxhash64(start_of(F.col("text")))), words)
    marked = rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(table), "word", "left")
    found = marked.withColumn("left_over", F.coalesce(F.expr("(shiftright(bits, bit) & 1) = 1"), F.lit(False)))
    digest = F.sha2(normalised(F.col("text")), 256)
    return found.withColumn("digest", digest if all_hashes else F.when(F.col("left_over"), digest)).drop("word", "bit", "bits")


def _order(n_chars: Column, ident: Column, *rest: Column) -> Column:
    """Of equal texts the row that comes first stays: most characters, then smallest id, null last."""
    return F.struct((-n_chars).alias("a"), ident.isNull().alias("b"), ident.alias("c"), *rest)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_hashes: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, digest), one row for each row of docs.

    keep_id is the id of the row that stays of those whose texts are equal: the one of most code points before white space
    is deleted, then of the smallest id (null last). Of rows equal in both exactly one has kept. digest is the SHA-256 of
    the text without white space; where no second text came near it is null, unless all_hashes. A null text is the empty
    one. An empty table gives no rows. Other columns, whatever their names, play no part.
    """
    ident = F.col(id_col).cast("long")
    rows = docs.select(ident.alias("id"), F.col(text_col).alias("text"))
    size = F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")
    narrow = written(hashed(rows, all_hashes).select("id", size, "left_over", "digest").withColumn("row", F.monotonically_increasing_id()), "digests")
    some = narrow.where("left_over")
    first = F.min(_order(F.col("n_chars"), F.col("id"), F.col("row")))
    groups = some.groupBy(F.col("digest").alias("d")).agg(first.alias("first"), F.count("*").alias("group_size"))
    told = some.join(groups, F.col("digest") == F.col("d")).select("id", F.col("first.c").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")
    alone = narrow.where("not left_over").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return told.unionByName(alone)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each group of equal texts (cases as in exact_groups); columns as in docs.

    Only texts that are left over are shuffled, one of a group from each task: the row that stays is found by partial
    aggregation. Of rows equal in length and id any one stays, the same on every run.
    """
    rows = hashed(boxed(docs, id=F.col(id_col).cast("long"), text=F.col(text_col)))
    tie = F.xxhash64(*[F.col("row").getField(c).cast("string") for c in docs.columns])
    order = _order(F.length(F.coalesce("text", F.lit(""))), F.col("id"), tie.alias("d"))
    best = rows.where("left_over").groupBy("digest").agg(F.min_by("row", order).alias("row"))
    return unboxed(rows.where("not left_over").select("row").unionByName(best.select("row")), docs.columns)
