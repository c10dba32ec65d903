"""Filter interaction audit: what each of some filters removes, in every order they may be applied in, without running any twice.

A scan tells which filters each document fails: its mask. Counts of masks (32 cells a part, for five filters) hold all
that orders depend on. A walk through all subsets of filters in the order of a Gray code toggles one filter at a time: the
cells that fail it get one more or one less active failure, and a cell is among the survivors as long as it has none. The
32 states of a part are stored; a step of an order is the difference of two of them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import blocks_of, text_views

FILTERS = "ABCDE"
#: Filter A: words at least; B: of a hundred words, distinct ones at least; C: of a hundred characters, capitals at most; D: characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
COUNTS = ("n", "good", "toxic")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True


def failures(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text of a block without nulls fails."""
    data, places = text_views(texts)
    n = len(texts)

    def counts(at: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(at, dtype=np.int64))[places])

    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edge = places[1:-1][(places[1:-1] > 0) & (places[1:-1] < len(data))]  # where one text meets the next, words end and begin
    begins[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    words = counts(begins)
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # a view on the bytes for each word, numbered by Arrow; then distinct numbers for each text
    bare = data[solid]
    cuts = np.append(0, np.cumsum(last - first)).astype(np.int32)
    numbers = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(bare)]).dictionary_encode().indices.to_numpy()
    pairs = np.unique((np.repeat(np.arange(n), words) << 32) | numbers)
    distinct = np.bincount(pairs >> 32, minlength=n)
    chars = counts((data & 0xC0) != 0x80)
    capitals = counts((data >= 65) & (data <= 90))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * chars, counts(_MARK[data]) > 0)
    return sum(f.astype(np.int64) << k for k, f in enumerate(fails))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask), one row for each row of docs; bit k of mask: the document fails filter k.

    Filter E: the text is identical to that of a smaller id anywhere in docs. Null ids come after all others, and rows of
    one id are not smaller than each other. A null text is the empty one, a null part the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in blocks_of(batch.column(2)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                data, places = text_views(texts)
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in itertools.pairwise(places.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(failures(texts)), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    told = written(rows.mapInArrow(run, "id long, part string, mask long, digest binary"), "masks")
    first = told.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count("*").alias("rows")).where((F.col("rows") > 1) & F.col("first").isNotNull())
    later = F.coalesce((F.col("id") > F.col("first")) | (F.col("id").isNull() & F.col("first").isNotNull()), F.lit(False))
    found = told.join(first, F.col("digest") == F.col("d"), "left")
    return found.select("id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """masked (id, part, mask), labels (id_col, quality, toxic) -> (part, cells): for each part a list of (mask, n, good, toxic).

    A document is good or toxic if any row of labels with its id says 1; a null id has no label. A list has a cell for each
    mask at most, so it is bounded.
    """
    yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).cast("long").alias(c)
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(yes("quality"), yes("toxic"))
    none = F.lit(0).cast("long")
    met = masked.where("id is not null").join(own, F.col("id") == F.col("label_id"), "left").select("part", "mask", F.coalesce("quality", none).alias("quality"), F.coalesce("toxic", none).alias("toxic"))
    every = met.unionByName(masked.where("id is null").select("part", "mask", none.alias("quality"), none.alias("toxic")))
    counted = every.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """counts (parts, cells, k) -> states (parts, subsets, k): the sums over those cells that no filter of a subset fails."""
    parts, size, _ = counts.shape
    states = np.zeros_like(counts)
    failing = np.zeros(size, np.int64)  # of each cell, how many of the active filters it fails
    alive = counts.sum(axis=1)
    bits = np.arange(size)
    states[:, 0] = alive
    subset = 0
    for step in range(1, size):
        f = (step & -step).bit_length() - 1  # the filter that is toggled
        subset ^= 1 << f
        own = bits >> f & 1 == 1
        if subset >> f & 1:
            alive = alive - counts[:, own & (failing == 0)].sum(axis=1)
            failing[own] += 1
        else:
            failing[own] -= 1
            alive = alive + counts[:, own & (failing == 0)].sum(axis=1)
        states[:, subset] = alive
    return states


def in_all_orders(states: np.ndarray) -> np.ndarray:
    """states (parts, subsets) -> (parts, filters): what each filter removes, summed over all orders of the filters.

    A subset of k of m filters stands right before a filter in k! (m - 1 - k)! orders.
    """
    m = states.shape[1].bit_length() - 1
    total = np.zeros((len(states), m), np.int64)
    for f in range(m):
        for s in (s for s in range(1 << m) if not s >> f & 1):
            ways = math.factorial(s.bit_count()) * math.factorial(m - 1 - s.bit_count())
            total[:, f] += ways * (states[:, s] - states[:, s | 1 << f])
    return total


def subset_states(found: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """found (part, cells) -> (part, states, cells, shapley): n, good and toxic of the survivors of each subset of filters, at its
    number; the same of each mask, at its number; and what each filter removes in all orders together."""
    size = 1 << filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, parent = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            counts = np.zeros((batch.num_rows, size, len(COUNTS)), np.int64)
            for k, name in enumerate(COUNTS):
                counts[parent, flat.field("mask").to_numpy(), k] = flat.field(name).to_numpy()
            as_lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), pa.StructArray.from_arrays([pa.array(x[:, :, k].ravel()) for k in range(len(COUNTS))], names=list(COUNTS)))
            states = gray_walk(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(states), as_lists(counts), pa.array(list(in_all_orders(states[:, :, 0])), pa.list_(pa.int64()))], names=["part", "states", "cells", "shapley"])

    shape = "array<struct<n: bigint, good: bigint, toxic: bigint>>"
    return found.select("part", "cells").mapInArrow(run, f"part string, states {shape}, cells {shape}, shapley array<bigint>")


def order_steps(states: DataFrame, filters: Sequence[str] = tuple(FILTERS)) -> DataFrame:
    """states (part, states, cells, shapley) -> for each part, order of the filters and step what the step keeps and removes.

    Every step is the difference of the states before and after it.
    """
    orders = list(itertools.permutations(range(len(filters))))
    before = [sum(1 << f for f in order[:k]) for order in orders for k in range(len(filters))]
    which = [f for order in orders for f in order]
    at = lambda values, i: F.get(F.lit(values), i)
    rows = states.select("part", "states", "cells", "shapley", F.explode(F.sequence(F.lit(0), F.lit(len(which) - 1))).alias("i"))
    rows = rows.select("part", at(["".join(filters[f] for f in order) for order in orders], (F.col("i") / len(filters)).cast("int")).alias("filter_order"), (F.col("i") % len(filters) + 1).alias("step"), at(before, F.col("i")).alias("before"), at(which, F.col("i")).alias("f"), "states", "cells", "shapley")
    state = lambda subset, name: F.get("states", subset)[name]
    bit = F.expr("shiftleft(1, f)")
    lost = lambda name: state(F.col("before"), name) - state(F.col("before") + bit, name)
    failing = state(F.lit(0), "n") - state(bit, "n")

    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), state(F.col("before") + bit, "n").alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        F.get("cells", bit)["n"].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapley", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part of docs, each
    order of the five filters and each step.

    Cases as in masks and cells: null texts are empty, null parts the empty string, null ids come last and have no label,
    repeated rows count each; other columns play no part. An empty table gives no rows.
    """
    return order_steps(subset_states(cells(masks(docs, id_col, text_col, part_col), labels, id_col)))
