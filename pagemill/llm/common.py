"""Shared helpers of the training-data operators: table access, written intermediate tables, row keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import n_written, remove_written, shared_dir, written

__all__ = ["WORD", "ascii_lower_words", "boxed", "let", "n_written", "remove_written", "shared_dir", "table", "text_bytes", "unboxed", "word_list", "written"]

#: A word everywhere in this subpackage: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def boxed(docs: DataFrame, **own: Column) -> DataFrame:
    """docs as one struct column `row`, beside columns of our own, so that no name of the caller's meets one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in own.items()])


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The caller's columns out of `row`, some of them with new values, and new ones after them."""
    kept = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]
    return df.select(*kept, *[v.alias(k) for k, v in new.items() if k not in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it.

    A column that lambdas of a later column refer to is not safe for that: a filter on the later column is pushed below
    both, and then the former is computed anew for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_list(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case: bytes.lower and bytes.split touch and cut at ASCII only."""
    return text_bytes(text).lower().split()
