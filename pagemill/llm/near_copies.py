"""Near copies: texts whose shingle sets have a Jaccard likeness of at least a threshold, all of them and no others.

SimHash look-ups (multi-index hashing) propose most links. What they miss is found by prefixes: in any order of all
shingles, two sets of likeness t have a common shingle among the first n - ceil(t * n) + 1 of each. The order is by hash,
with the hottest shingles last: those that a sample of the texts shows, and those that fill a bucket nevertheless, for which
prefixes are taken anew. So a common line stands far back in every text, where it bounds what two texts can have in common
(components.bucket_links): pages of one template, alike in less than the threshold, do not meet. The result does not depend
on which shingles count as hot. Every proposed pair is verified on the exact sets.

Links are found in passes: by one look-up of each text, which joins most of each group; by its other look-ups, where they
meet other components; then between a representative of each bucket
of a prefix shingle and the bucket's rows of other components; then between rows of a bucket whose components still differ.

Texts with the same shingle set are one node, whatever their ids, so ids may repeat or be null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, n_written, remove_written, unboxed, written
from .components import bucket_links, connected_components
from .simhash import first_pairs, further_pairs, looked_up, majority, within
from .words import shingles_of

#: Texts that are sampled for hot shingles, how many of them a hot shingle stands in, and most hot shingles of a round.
SAMPLE_TEXTS, HOT_TEXTS, HOT_SHINGLES = 20_000, 3, 100_000
#: A table of texts that are wanted again is broadcast up to this many rows (16 bytes each).
BROADCAST_ROWS = 500_000
#: A shingle that more texts than this have in their prefixes is hot too, and prefixes are taken anew; in so many rounds at most.
CROWDED, ROUNDS = 1_000, 3


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def prefix(hashes: np.ndarray, hot: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of a set (distinct, ascending); those in hot (ascending, not empty) come after all others."""
    is_hot = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
    n = len(hashes)
    return np.concatenate([hashes[~is_hot], hashes[is_hot]])[: n - math.ceil(threshold * n - 1e-9) + 1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    places = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(flat.view(np.int64)))


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rows (text) -> (node, shingles), a row for each row; node stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(s) for s in shingles_of(b.column(0), shingle)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), _lists(sets)], names=["node", "shingles"])

    return rows.select("text").mapInArrow(run, "node long, shingles array<long>")


def in_several(sets: DataFrame, texts: int) -> np.ndarray:
    """Shingles that stand in at least so many of some sets, HOT_SHINGLES at most, in order; a number that is none if there are none."""
    counts = sets.select(F.explode_outer("shingles").alias("s")).where("s is not null").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= texts)
    found = [r["s"] for r in counts.orderBy(F.desc("n"), "s").limit(HOT_SHINGLES).select("s").collect()]
    return np.sort(np.array(found or [0], np.int64).view(np.uint64))


def hot_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that stand in many texts of a sample."""
    share = SAMPLE_TEXTS / max(rows.count(), 1)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), F.col("id"), F.col("key")), F.lit(1_000_000)) / 1e6 < share)
    return in_several(shingle_sets(sample, shingle), HOT_TEXTS)


def signatures(rows: DataFrame, shingle: int, threshold: float, n_longs: int, hot: np.ndarray) -> DataFrame:
    """rows (id, key, text) -> (id, key, node, n, fp, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, nodes, sizes, first = [], [], [], []
            for hashes in shingles_of(b.column(2), shingle):
                own = np.unique(hashes)
                prints.append(majority(hashes, n_longs))
                nodes.append(_digest(own))
                sizes.append(len(own))
                first.append(prefix(own, hot, threshold))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(prints), _lists(first)], names=["id", "key", "node", "n", "fp", "prefix"])

    return rows.select("id", "key", "text").mapInArrow(run, "id long, key long, node long, n long, fp array<long>, prefix array<long>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (row, id, key, text); key tells texts of one id apart."""
    ident, text = F.col(id_col).cast("long"), F.col(text_col)
    return boxed(docs, id=ident, key=F.xxhash64(ident, text), text=text)


def near_copy_groups(rows: DataFrame, threshold: float = 0.8, shingle: int = 5, n_longs: int = 1, segments: int = 2, segment_bits: int = 32, radius: int = 1, max_distance: int = 3) -> DataFrame:
    """rows (id, key, text) -> (id, key, group) for each row: rows of one group are connected by links.

    A link: two texts whose shingle sets have a likeness of at least threshold (texts without words are alike). segments,
    segment_bits, radius and max_distance are those of the SimHash look-ups and have no influence on the result. An empty
    table gives no rows.
    """

    def texts_of(nodes: DataFrame) -> DataFrame:
        """Of each of some nodes a row, to read its text again."""
        wanted = written(reps.join(nodes, reps["rep"] == nodes["node"], "left_semi").select(F.col("id").alias("i"), F.col("key").alias("k")).distinct(), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted  # else texts are shuffled to find a few of them
        return rows.join(wanted, rows["id"].eqNullSafe(wanted["i"]) & (rows["key"] == wanted["k"]), "left_semi")

    spark = rows.sparkSession
    hot = hot_shingles(rows, shingle)
    for left in reversed(range(ROUNDS)):
        signs = written(signatures(rows, shingle, threshold, n_longs, hot), "signatures")
        # a row for each node (or several alike, if a row of docs is repeated)
        reps = written(signs.groupBy("node").agg(F.min(F.struct("id", "key")).alias("r")).select(F.col("node").alias("rep"), "r.*"), "nodes")
        one = signs.join(reps, (signs["node"] == reps["rep"]) & signs["id"].eqNullSafe(reps["id"]) & (signs["key"] == reps["key"]), "left_semi").select("node", "n", "fp", "prefix")
        # nodes by the shingles of their prefixes; rest: a shingle and those after it
        keys = one.select("node", "n", F.posexplode_outer("prefix").alias("at", "key")).where("key is not null")
        buckets = written(keys.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("first"), F.max("node").alias("last")).where("k > 1"), "buckets")
        full = buckets.where(F.col("k") > CROWDED).orderBy(F.desc("k"), "key").limit(HOT_SHINGLES)
        more = np.setdiff1d(np.array([r["key"] for r in full.select("key").collect()], np.int64).view(np.uint64), hot)
        if not left or not len(more):
            break
        # with a bucket's shingle come those that two of its texts have in common: a whole template at once
        two = texts_of(full.select(F.explode(F.array("first", "last")).alias("node")).distinct())
        hot = np.union1d(hot, np.union1d(more, in_several(shingle_sets(two, shingle).dropDuplicates(["node"]), 2)))
    crowded = written(keys.join(buckets.select("key"), "key").select("key", "node", "n", (F.col("n") - F.col("at")).alias("rest")), "crowded")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of those pairs (a, b) that are links. What is written on the way is deleted at the end."""
        before = n_written(spark)
        pairs = written(pairs.distinct(), "proposed")
        some = written(pairs.select(F.col("a").alias("p")).union(pairs.select(F.col("b").alias("p"))).distinct(), "some")
        few = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        known = one.join(few, F.col("node") == F.col("p"), "left_semi").select("node", "n", "prefix")
        x, y = (known.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}")) for c in "ab")
        alike = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
        # common shingles are in both prefixes, or after the end of that prefix which ends first
        most = F.size(F.array_intersect("pa", "pb")) + F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
        possible = alike & (most * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-6)
        left = written(pairs.join(x, "a").join(y, "b").where(possible).select("a", "b"), "pairs")
        nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
        sets = written(shingle_sets(texts_of(nodes), shingle).dropDuplicates(["node"]), "shingles")
        shared = F.size(F.array_intersect("sa", "sb"))
        exact = shared / (F.size("sa") + F.size("sb") - shared) >= threshold
        sa, sb = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
        found = written(left.join(sa, "a").join(sb, "b").where(exact).select("a", "b"), "links")
        remove_written(spark, before, keep_last=1)
        return found

    prints = one.select(F.col("node").alias("id"), "fp")
    hits = looked_up(prints, segments, segment_bits, radius)
    near = lambda pairs: verified(within(pairs, prints, n_longs, max_distance))
    links = near(first_pairs(hits))
    links = links.unionByName(near(further_pairs(hits, connected_components(links))))
    links = bucket_links(crowded, links, verified, threshold)
    groups = reps.select(F.col("rep").alias("node")).join(connected_components(links), "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    return signs.select("id", "key", "node").join(groups, "node").select("id", "key", "group")


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row (id, component) for each row of docs; component: the smallest id of its group (near_copy_groups).

    A null id keeps its row and its links and counts as the largest of its group; a group without ids has a null component.
    """
    groups = near_copy_groups(keyed(docs, id_col, text_col), **options)
    return groups.join(groups.groupBy("group").agg(F.min("id").alias("component")), "group").select("id", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near copies: of each group (near_copy_groups) the row of the smallest id stays, of equal ids one text.

    A null id counts as the largest. Of rows equal in id and text one stays. Columns as in docs; their names do not matter.
    """
    rows, before = keyed(docs, id_col, text_col), n_written(docs.sparkSession)
    groups = near_copy_groups(rows, **options)
    best = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    texts = groups.groupBy("group", "id", "key").agg(F.count("*").alias("n"))
    kept = written(texts.groupBy("group").agg(F.min(best).alias("b"), F.min_by("n", best).alias("n")).select(F.col("b.id").alias("i"), F.col("b.key").alias("k"), "n"), "kept")
    remove_written(docs.sparkSession, before, keep_last=1)

    def of(some: DataFrame) -> DataFrame:
        return rows.join(some, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi")

    # only rows that are there more than once are grouped
    others = F.xxhash64(*[F.col("row").getField(c).cast("string") for c in docs.columns if c != text_col])
    again = of(kept.where("n > 1")).groupBy("id", "key").agg(F.min_by("row", others).alias("row"))
    return unboxed(of(kept.where("n = 1")).select("row").unionByName(again.select("row")), docs.columns)
