"""The vector table: what changed, which vectors can be kept, and insert-or-replace."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.providers import count_tokens


def diff(stored: DataFrame, rows: DataFrame, key: str = "unit_id", digest: str = "embed_hash") -> DataFrame:
    """(key, stored_hash, new_hash, status): new, changed, same, or stale (stored only; such rows are never deleted)."""
    a = stored.select(key, F.col(digest).alias("stored_hash"))
    b = rows.select(key, F.col(digest).alias("new_hash"))
    status = F.when(F.col("stored_hash").isNull(), "new").when(F.col("new_hash").isNull(), "stale").when(F.col("stored_hash") == F.col("new_hash"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").withColumn("status", status)


def reusable(stored: DataFrame, digest: str = "embed_hash") -> DataFrame:
    """One vector for each hash."""
    return stored.groupBy(digest).agg(F.max_by("embedding", "unit_id").alias("kept"))


@dataclass(frozen=True)
class Model:
    """An embedding model: how it is loaded (once in each worker), how it counts tokens, and what one call may hold.

    load() gives a function from texts to vectors. A call holds texts of like length, most_texts at most, and most_tokens
    at most with all of them padded to the longest; a longer text goes alone. With unit_length, vectors of another length
    are an error.
    """

    name: str
    load: Callable[[], Callable[[list[str]], list[list[float]]]]
    count: Callable[[list[str]], list[int]] = count_tokens
    most_tokens: int = 8192
    most_texts: int = 64
    unit_length: bool = True

    def vectors(self, texts: list[str]) -> list[list[float]]:
        encode = _LOADED.get(self.name)
        if encode is None:
            encode = _LOADED[self.name] = self.load()
        out: list[list[float] | None] = [None] * len(texts)
        for batch in token_batches(self.count(texts), self.most_tokens, self.most_texts):
            made = encode([texts[i] for i in batch])
            if len(made) != len(batch):
                raise ValueError(f"{self.name}: {len(made)} vectors for {len(batch)} texts")
            if self.unit_length and not np.allclose(np.linalg.norm(np.asarray(made, float), axis=1), 1, atol=LENGTH_ROOM):
                raise ValueError(f"{self.name}: vectors are not of length one")
            for i, v in zip(batch, made, strict=True):
                out[i] = v
        return out


#: Models that this worker process has loaded, and how far a length may be from one.
_LOADED: dict[str, Callable[[list[str]], list[list[float]]]] = {}
LENGTH_ROOM = 1e-3


def token_batches(sizes: list[int], most_tokens: int, most_texts: int) -> list[list[int]]:
    """Places of texts of some sizes in tokens, dealt into batches: like sizes together, the longest first, each batch within
    most_texts and, padded to its longest, within most_tokens (or a single text)."""
    batches: list[list[int]] = []
    longest = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if not batches or len(batches[-1]) >= most_texts or longest * (len(batches[-1]) + 1) > most_tokens:
            batches.append([])
            longest = max(sizes[i], 1)
        batches[-1].append(i)
    return batches


def embedded(todo: DataFrame, stored: DataFrame, embed: Model | Callable[[list[str]], list[list[float]]], text: str = "embed_text", digest: str = "embed_hash") -> DataFrame:
    """todo with embedding: a stored vector of the same hash, or else a fresh one. Only texts without one are embedded.

    embed: a Model, or a function from texts to vectors that needs no loading.
    """
    joined = todo.join(reusable(stored), digest, "left")
    fresh = joined.where("kept is null").select(digest, text).dropDuplicates([digest])
    make = embed.vectors if isinstance(embed, Model) else embed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({digest: b[digest], "fresh": make(b[text].tolist())})

    made = fresh.mapInPandas(run, f"{digest} string, fresh array<float>")
    return joined.join(made, digest, "left").withColumn("embedding", F.coalesce("kept", "fresh")).drop("kept", "fresh")


def upserted(stored: DataFrame, rows: DataFrame, key: str = "unit_id") -> DataFrame:
    """The stored table after insert-or-replace by key."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows.select(*stored.columns))


def metadata(units: DataFrame, source_dir: str, model: str) -> DataFrame:
    """What the vector table stores beside the vector; no id is -1."""
    return units.select("unit_id", "chunk_id", F.coalesce("page_id", F.lit(-1)).alias("page_id"), F.coalesce("book_id", F.lit(-1)).alias("book_id"), F.lit(source_dir).alias("source_dir"), F.array_join("path", " > ").alias("path"), "section", F.lit(model).alias("embed_model"), "embed_hash")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def too_long(rows: DataFrame, count: Callable[[list[str]], list[int]], limit: int, text: str = "embed_text", key: str = "unit_id") -> DataFrame:
    """(key, tokens) of rows whose text has more tokens than a model takes; the model would cut them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "tokens": count(b[text].tolist())})

    return rows.select(key, text).mapInPandas(run, f"{key} string, tokens long").where(F.col("tokens") > limit)

