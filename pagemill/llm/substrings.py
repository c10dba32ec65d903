"""Substring dedup by sliding sentence spans, then by windows of words.

A text is cut into sentences, at end marks and line ends. Every run of several consecutive sentences is hashed; the hashes
are counted over all texts, and every occurrence of a run after its first (by document id, then place) is removed.

What spans miss, as a passage that is glued into other sentences at both ends, is found in the texts that are left: every
run of WINDOW words that stands in an earlier place goes, word by word. Of the runs of GRAM words, each text puts the least
of every WINDOW - GRAM + 1 consecutive ones forward (winnowing), so that two texts with a common run of WINDOW words have a
common gram; only around such grams are all windows hashed and counted.

Only hashes, ids and places are shuffled to find repeats (a hash of any frequency is a partial aggregate, and the join
that follows repeats it on one side only); the texts are shuffled to meet their own places, and are written in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import WORD, text_bytes, unboxed, written
from .words import blocks_of, numbered_words

#: Words of a run that may stand only once, and of the grams that are put forward to find it.
WINDOW, GRAM = 50, 20
#: Base of the rolling hashes, odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MARKS = b".!?,;:"
#: A span is this many sentences, or as many more as make so many words.
RUN, MIN_WORDS = 3, 25

#: Texts that repeat something: up to so many, their ids (two longs each) are broadcast.
BROADCAST_IDS = 500_000

#: A sentence with the white space after it (ASCII only, so that all regular expression libraries agree). Every character of
#: a text is in exactly one.
SENTENCE = "[^.!?\n]+[.!?\n]*[ \t\x0b\f\r\n]*|[.!?\n]+[ \t\x0b\f\r\n]*"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def _norm_hash(sentence: Column) -> Column:
    """Hash of a sentence in lower case without white space and marks; null if nothing is left."""
    bare = F.regexp_replace(F.lower(sentence), r"[\s.!?,;:]+", "")
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def repeated_sentences(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc long, key long, text) -> (doc, key, ranges array<start, end>): the sentences that a non-first repeat covers."""
    pieces = docs.select("doc", "key", sentences(F.col("text")).alias("pieces"))
    numbered = pieces.select("doc", "key", F.transform("pieces", lambda s, i: F.struct(i.alias("place"), _norm_hash(s).alias("h"), (F.size(F.split(F.trim(s), r"\s+"))).alias("words"))).alias("all"))
    real = numbered.select("doc", "key", F.filter("all", lambda s: s["h"].isNotNull()).alias("s"))

    start = F.struct(F.lit(42).cast("long").alias("h"), F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def grow(a: Column, s: Column) -> Column:
        more = F.struct(F.xxhash64(a["h"], s["h"]).alias("h"), (a["words"] + s["words"]).alias("words"), (a["n"] + 1).alias("n"), s["place"].alias("end"))
        return F.when((a["n"] < run) | (a["words"] < min_words), more).otherwise(a)

    def span(i: Column) -> Column:
        # a sentence has a word at least, so min_words of them are enough
        grown = F.aggregate(F.slice(F.col("s"), i + 1, F.lit(max(run, min_words))), start, grow)
        return F.struct(grown.alias("r"), F.get("s", i)["place"].alias("start"))

    last = F.greatest(F.size("s") - run, F.lit(0))
    runs = real.select("doc", "key", F.when(F.size("s") > 0, F.filter(F.transform(F.sequence(F.lit(0), last), span), lambda x: x["r"]["words"] >= min_words)).alias("runs"))
    # explode_outer: for explode, Spark would add a filter on the array's size and compute the sentences anew inside it
    spans = runs.select("doc", "key", F.explode_outer("runs").alias("x")).where("x is not null")
    rows = written(spans.select("x.r.h", "doc", "key", "x.start", "x.r.end"), "spans")
    order = F.coalesce("doc", F.lit((1 << 63) - 1))
    # written, so that the join that follows is between two tables, of which Spark can split a frequent hash
    common = written(rows.groupBy("h").agg(F.count("*").alias("n"), F.min(order).alias("low")).where("n > 1"), "common")
    found = written(rows.join(common, "h").select("h", "doc", "key", "start", "end", (order == F.col("low")).alias("leads")), "repeats")
    first = written(found.where("leads").groupBy("h").agg(F.min(F.struct("key", "start")).alias("first")), "first")
    again = found.join(first, "h").where(~F.col("leads") | (F.struct("key", "start") != F.col("first")))
    return again.groupBy("doc", "key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("end") + 1).alias("end")))).alias("ranges"))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    powers, inverse = np.full(n, BASE, np.uint64), np.full(n - k + 1, pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
    x = (sums[k:] - sums[:-k]) * inverse
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _grams(words: np.ndarray) -> np.ndarray:
    """Hashes of the grams that a text (by its word hashes) puts forward; none if it has fewer words than a window."""
    grams = _rolled(words, GRAM)
    span = WINDOW - GRAM + 1
    if len(grams) < span:
        return grams[:0]
    least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    return grams[np.unique(least + np.arange(len(least)))]


def _windows(text: str, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, start, end) of the windows around those grams of a text that are in common; start, end: characters."""
    words = [(w, m.start()) for m in re.finditer(WORD, text) if (w := text_bytes(m.group()).lower().translate(None, MARKS))]
    hashes = _word_hashes([w for w, _ in words])
    windows = _rolled(hashes, WINDOW)
    hit = np.isin(_rolled(hashes, GRAM), common)
    counts = np.concatenate([[0], np.cumsum(hit)])
    at = np.flatnonzero(counts[np.arange(len(windows)) + WINDOW - GRAM + 1] > counts[np.arange(len(windows))])
    starts = np.array([*(i for _, i in words), len(text)], np.int64)
    return windows[at].view(np.int64), at.astype(np.int64), starts[at], starts[at + WINDOW]


def repeated_words(docs: DataFrame) -> DataFrame:
    """docs (doc long, key long, text) -> (doc, key, ranges array<start, end>): characters that a non-first window covers."""

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = []
            for block in blocks_of(b.column(2)):
                hashes, numbers, counts = numbered_words(block, MARKS)
                grams += [_grams(w).view(np.int64) for w in np.split(hashes[numbers], np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grams, pa.list_(pa.int64()))], names=["doc", "key", "grams"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, text, common in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = _windows(text, np.array(common, np.int64).view(np.uint64))
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), *map(pa.array, found)], names=["doc", "key", "h", "place", "start", "end"])

    docs = docs.select("doc", "key", "text")
    put = written(docs.mapInArrow(forward, "doc long, key long, grams array<long>").select("doc", "key", F.explode_outer("grams").alias("g")).where("g is not null"), "grams")
    common = written(put.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "common")
    near = written(put.join(common, "g").groupBy("doc", "key").agg(F.collect_set("g").alias("grams")).withColumnsRenamed({"doc": "d", "key": "k"}), "near")
    met = _touched(docs, near)[0].where("grams is not null").select("doc", "key", "text", "grams")
    rows = written(met.mapInArrow(around, "doc long, key long, h long, place long, start long, end long"), "windows")
    order = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), "key", "place")
    first = written(rows.groupBy("h").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n"), "first")
    # in the text of the first itself, only what does not overlap it
    same = (F.col("key") == F.col("first.key")) & (order["doc"] == F.col("first.doc"))
    again = rows.join(first, "h").where(~same | (F.col("place") >= F.col("first.place") + WINDOW))
    return again.groupBy("doc", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Ranges (start, end) in order, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


CUT = StructType([StructField("text", StringType()), StructField("touched", IntegerType())])


@F.pandas_udf(CUT)
def without_sentences(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    """Texts without ranges of their sentences, and how many those are. Rows without a text stay so."""
    rows = []
    for t, found in zip(text, ranges, strict=True):
        if t is None:
            rows.append((None, 0))
            continue
        pieces, kept, at, gone = re.findall(SENTENCE, t), [], 0, 0
        for start, end in merged(found):
            kept += pieces[at:start]
            gone, at = gone + end - start, end
        rows.append(("".join(kept + pieces[at:]), gone))
    return pd.DataFrame(rows, columns=["text", "touched"])


@F.pandas_udf(CUT)
def without_characters(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    """Texts without ranges of their characters, and how many sentences lose a character."""
    rows = []
    for t, found in zip(text, ranges, strict=True):
        if t is None:
            rows.append((None, 0))
            continue
        ends = np.cumsum([len(s) for s in re.findall(SENTENCE, t)])
        kept, at, touched, last = [], 0, 0, -1
        for start, end in merged(found):
            kept.append(t[at:start])
            at = end
            first, upto = np.searchsorted(ends, [start, end - 1], "right").tolist()
            touched += upto - max(first, last + 1) + 1
            last = upto
        rows.append(("".join([*kept, t[at:]]), touched))
    return pd.DataFrame(rows, columns=["text", "touched"])


def _touched(rows: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows (doc, key, ...) that side (d, k, ...; each once) has, with side's columns; and the others (None: they are among the
    first, with nulls).

    Few texts repeat something. Up to BROADCAST_IDS of them, their ids are sent to all tasks and only their texts are shuffled.
    """
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    ids = side.select("d", "k")
    if ids.count() > BROADCAST_IDS:
        return rows.join(side, same, "left"), None
    ids = F.broadcast(ids)
    return rows.join(ids, same, "left_semi").join(side, same), rows.join(ids, same, "left_anti")


def _cut(rows: DataFrame, ranges: DataFrame, cut) -> DataFrame:
    """rows (row, doc, key, text, touched) with the ranges of each text cut out of it."""
    joined, others = _touched(rows, ranges.withColumnsRenamed({"doc": "d", "key": "k"}))
    # only texts that lose something go through Python
    found = joined.withColumn("new", cut(F.when(F.col("ranges").isNotNull(), F.col("text")), F.col("ranges")))
    done = found.select("row", "doc", "key", F.when(F.col("ranges").isNotNull(), F.col("new.text")).otherwise(F.col("text")).alias("text"), (F.col("touched") + F.coalesce("new.touched", F.lit(0))).alias("touched"))
    return done if others is None else done.unionByName(others)


def _cleaned(docs: DataFrame, id_col: str, text_col: str, run: int, min_words: int) -> DataFrame:
    """(row, text, touched): docs as a struct without the text column, the text that is left, the sentences that lost something."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    # the row carries the old length in the text's place
    rows = docs.select(F.struct(*[(F.length(text) if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns]).alias("row"), doc.alias("doc"), F.xxhash64(doc, text).alias("key"), text.alias("text"), F.lit(0).alias("touched"))
    found = written(repeated_sentences(rows.select("doc", "key", "text"), run, min_words), "ranges")
    spans = written(_cut(rows, found, without_sentences), "spans-cut")
    ranges = written(repeated_words(spans.select("doc", "key", "text")), "ranges")
    return _cut(spans, ranges, without_characters)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs with repeated spans and windows cut out of the text, and n_removed and removed_chars (in
    place of columns of docs with such names).

    A span is run consecutive sentences, or as many more as make min_words words. Only the first occurrence of a span
    stays, in the order of id (null last) and place. Then the same holds for every run of WINDOW words of what is left.
    All compare without case, white space and marks. n_removed: sentences that lose something. A text that loses nothing
    stays as it is; null stays null; a text may become empty. Rows equal in id and text are one document (all keep what it
    keeps). An empty table gives no rows.
    """
    done = _cleaned(docs, id_col, text_col, run, min_words)
    removed = F.coalesce(F.col("row").getField(text_col) - F.length("text"), F.lit(0)).cast("long")
    return unboxed(done, docs.columns, **{text_col: F.col("text"), "n_removed": F.col("touched"), "removed_chars": removed})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """docs with repeats cut out of the text and (where there is such a column) its new length; documents left without a word
    go. Columns as in docs."""
    done = _cleaned(docs, id_col, text_col, **({"run": RUN, "min_words": MIN_WORDS} | options)).where(F.col("text").rlike(WORD))
    new = {text_col: F.col("text")}
    if n_chars in docs.columns:
        new[n_chars] = F.length("text").cast("long")
    return unboxed(done, docs.columns, **new)
