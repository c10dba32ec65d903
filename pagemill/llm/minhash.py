"""MinHash document fingerprints: universal hash permutations over word shingles in vectorised numpy.

A fingerprint has one 16-bit number for each permutation: the low bits of the least value of (a * h + b) over the
shingle hashes h. The share of equal numbers estimates the Jaccard likeness of two texts' shingles. Near copies are found
by joining bands of the signature in Spark and verifying the exact Jaccard likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower_words, written
from .components import bucket_links, connected_components

BLOCK = 1 << 12


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends modulo 2**64, of which the high bits are used (multiply-shift, universal)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles. Fewer words than a shingle: the whole sequence; no words: none."""
    words = ascii_lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh3_64_intdigest
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(join(words[i : i + shingle])) for i in range(n)), np.uint64, n))


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """uint16 for each permutation; all ones for no shingles."""
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), BLOCK):
        with np.errstate(over="ignore"):
            values = a[:, None] * hashes[None, at : at + BLOCK]
            values += b[:, None]
        values >>= np.uint64(32)
        np.minimum(least, values.min(axis=1).astype(np.uint32), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(x == y))


def edited(text: str, onward: str) -> str:
    """The text with its last half (rounded down) replaced by as much of onward, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + onward[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, n_perms: int = 128) -> DataFrame:
    """For each row of docs its fingerprint, that of its edited text, and the likeness to it and to the next document's.

    The next document: in descending id order (equal ids by text, null ids last), after the last the first. A table of
    one row is its own next. Null text is empty. An empty table gives no rows.

    Texts are range-partitioned by descending id, once. A task has its rows' next documents at hand, save for its last
    row: the first and last text of each partition are put aside (two rows a partition) and matched afterwards.
    """
    a, b = permutations(n_perms)

    def compare(key: int | None, text: str, onward: str, mine: np.ndarray, next_one: np.ndarray) -> tuple:
        new = edited(text, onward)
        other = signature(shingle_hashes(new, shingle), a, b)
        sha = hashlib.sha256(new.encode("utf-8", "replace")).digest()
        return key, len(text), sha, mine.tobytes(), other.tobytes(), likeness(mine, other), likeness(mine, next_one)

    def table(rows: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
        rows = [(*r, None, None, None) for r in rows] + [(None,) * len(NAMES) + e for e in ends]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NAMES, "end", "end_id", "end_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows, ends = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                mine = signature(shingle_hashes(text, shingle), a, b)
                if before is None:
                    ends.append((0, key, text))
                else:
                    rows.append(compare(before[0], before[1], text, before[2], mine))
                before = key, text, mine
            if rows or ends:
                yield table(rows, ends)
        if before is not None:
            yield table([], [(1, before[0], before[1])])

    order = [F.col("id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(order[0]).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(run, f"{RESULT}, end int, end_id long, end_text string").withColumn("part", F.when(F.col("end").isNotNull(), F.spark_partition_id())), "fingerprints")

    # a partition's last row meets the first row of the next partition that has rows; the very last meets the very first.
    # Only the partitions' numbers are put in order in one place
    ends = found.where("end is not null")
    heads = ends.where("end = 0").select(F.col("part").alias("next"), F.col("end_text").alias("onward"))
    chain = Window.orderBy("next")
    following = heads.select(F.col("next").alias("part"), F.coalesce(F.lead("next").over(chain), F.first("next").over(chain)).alias("next"))
    last = ends.where("end = 1").join(following, "part").join(heads, "next").select("end_id", "end_text", "onward")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, onward in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine, next_one = (signature(shingle_hashes(t, shingle), a, b) for t in (text, onward))
                rows.append(compare(key, text, onward, mine, next_one))
            if rows:
                yield table(rows, []).select(NAMES)

    done = found.where("end is null").select(*NAMES).unionByName(last.mapInArrow(finish, RESULT))
    return done.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in done.dtypes])


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, n_perms: int = 128, bands: int = 32, threshold: float = 0.8) -> DataFrame:
    """One row (id, class_id) for each row of docs: class_id the smallest id reachable over verified links, itself included.

    Documents that share a band of their signature are candidates; a pair links if the exact Jaccard likeness of their
    shingle sets is at least threshold (components.bucket_links: no candidate link is lost, and pairs within one class are
    not all made). Equal shingle sets are one node, and texts without words are alike. Ids may repeat; a null id keeps its
    row and its links and counts as the largest of its class (a class without ids has a null one). An empty table gives no
    rows.
    """
    a, b = permutations(n_perms)
    width = n_perms // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), shingle) for t in batch.column(1)]
            cuts = [signature(s, a, b).reshape(bands, width) for s in sets]
            keys = [[xxhash.xxh3_64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(c)] for c in cuts]
            digest = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "node", "bands", "shingles"])

    rows = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, node long, bands array<long>, shingles array<long>"), "signatures")
    # all rows of a node have the same bands and shingles
    one = written(rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles")), "distinct")
    looks = one.select("node", F.size("shingles").cast("long").alias("n"), F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "node", "n")
    shared = written(looks.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "buckets")
    crowded = written(looks.join(shared, "key").select("key", "node", "n", F.col("n").alias("rest")), "bands")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (one.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        exact = common / (F.size("sa") + F.size("sb") - common)
        return written(pairs.join(x, "a").join(y, "b").where(exact >= threshold).select("a", "b"), "links")

    comp = connected_components(bucket_links(crowded, None, verified, threshold))
    groups = one.select("node").join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    placed = rows.select("id", "node").join(groups, "node")
    return placed.join(placed.groupBy("group").agg(F.min("id").alias("class_id")), "group").select("id", "class_id")
