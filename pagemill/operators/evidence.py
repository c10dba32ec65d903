"""Which texts contain which passages, compared without white space and end marks (functions.text.squash).

A join on equal sentences would miss a passage that is glued into other sentences, and a common sentence would pair all its
holders. So texts put forward grams of characters by winnowing: of every SPAN consecutive grams the one of least hash. What
a passage puts forward, every text that contains it puts forward too, so one gram of the passage is enough to find them:
the one that the fewest texts have. Passages too short for that are sought all at once, by one automaton over all of them
that reads every text once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash
from ..sources.scratch import written

#: Characters of a gram, and grams of which one is put forward.
GRAM, SPAN = 16, 24
#: Up to so many grams of passages go to the texts (8 bytes each); more meet them by a join.
SENT_GRAMS = 500_000
#: About how many short passages one automaton holds; more take further scans.
AUTOMATON = 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str, k: int) -> np.ndarray:
    """64-bit hashes of the k-character windows of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = (x + points[j : j + n]) * _STEP
        x ^= x >> np.uint64(29)
    return x * _STEP


def put_forward(text: str, gram: int = GRAM, span: int = SPAN) -> np.ndarray:
    """The least hash of every span consecutive grams, each once; none for a text too short."""
    grams = gram_hashes(text, gram)
    if len(grams) < span:
        return grams[:0]
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, span).min(axis=1))


def _keys(rows: DataFrame, ident: str, of: Callable[[str], np.ndarray], wanted: np.ndarray | None = None) -> DataFrame:
    """rows (ident, s) -> (ident, key) for each hash that `of` gives for a text; with wanted (ascending), for those among them."""

    def chosen(text: str) -> np.ndarray:
        keys = of(text).view(np.int64)
        return keys if wanted is None else keys[wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({ident: b[ident], "keys": [chosen(s) for s in b["s"]]})

    found = rows.select(ident, "s").mapInPandas(run, f"{ident} long, keys array<long>")
    return found.select(ident, F.explode_outer("keys").alias("key")).where("key is not null")


def holding(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """texts (t, s), passages (s) -> (t, part) of each text and each passage in it.

    The passages are the words of an automaton that finds all of them in one pass over a text, however many there are and
    wherever they overlap. They are dealt to automata of bounded size by a hash; each takes a scan of the texts.
    """
    parts = written(passages.select(F.col("s").alias("part")).distinct(), "parts")
    count = parts.count()
    automata = -(-count // AUTOMATON)
    found = texts.select("t", F.lit("").alias("part")).limit(0)
    for k in range(automata):
        words = [r["part"] for r in parts.where(F.pmod(F.xxhash64("part"), F.lit(automata)) == k).collect()]  # short, and about AUTOMATON

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for n, word in enumerate(words):
                automaton.add_word(word, n)
            automaton.make_automaton()
            for b in batches:
                held = [{n for _, n in automaton.iter(s)} for s in b.column(1).to_pylist()] if words else [set()] * b.num_rows
                rows = np.repeat(np.arange(b.num_rows), [len(x) for x in held])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([words[n] for x in held for n in x], pa.string())], names=["t", "part"])

        found = found.unionByName(texts.select("t", "s").mapInArrow(run, "t long, part string"))
    return found


def containing(texts: DataFrame, passages: DataFrame, text_id: str, passage_id: str, text: str = "text", gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """texts (text_id, text), passages (passage_id, text) -> (passage_id, text_id) of every pair where the text contains the
    passage.

    Null texts and null passages are in no pair, nor is a passage without anything but white space and end marks. Repeated
    ids give a pair once.
    """
    held = texts.where(F.col(text).isNotNull()).select(F.col(text_id).cast("long").alias("t"), squash(F.col(text)).alias("s"))
    asked = written(passages.where(F.col(text).isNotNull()).select(F.col(passage_id).cast("long").alias("p"), squash(F.col(text)).alias("s")).where(F.length("s") > 0), "passages")
    least = gram + span - 1
    of = partial(put_forward, gram=gram, span=span)
    long = asked.where(F.length("s") >= least)
    wanted = written(_keys(long, "p", of), "wanted").distinct()
    known = wanted.select("key").distinct()
    if known.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS:
        sent = np.sort(np.array([r["key"] for r in known.collect()] or [0], np.int64))
        found = written(_keys(held, "t", of, sent).join(F.broadcast(known), "key", "left_semi"), "found")
    else:
        found = written(_keys(held, "t", of).join(known, "key", "left_semi"), "found")
    # of each passage the gram that the fewest texts have
    counts = known.join(found.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    rarest = wanted.join(counts, "key").groupBy("p").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    pairs = found.join(rarest, "key").select("p", "t")
    both = pairs.distinct().join(asked.select("p", F.col("s").alias("part")), "p").join(held, "t")
    whole = both.where(F.contains("s", F.col("part"))).select("p", "t")
    short = asked.where(F.length("s") < least)
    inside = holding(held, short).join(short.select("p", F.col("s").alias("part")), "part").select("p", "t")
    return whole.unionByName(inside).select(F.col("p").alias(passage_id), F.col("t").alias(text_id)).distinct()
