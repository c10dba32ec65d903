"""A training corpus from raw documents: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents
(doc_id, text, lang, source, n_chars; n_chars follows a text that is cut). Stages take any further columns along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import table, written
from pagemill.llm.mixing import mix
from pagemill.llm.near_copies import one_of_each
from pagemill.llm.packing import pack
from pagemill.llm.quality import without_bad_lines
from pagemill.llm.substrings import without_repeats

#: Near copies: fingerprints of 256 bits over five-word shingles. Two texts of shingle likeness 0.8 differ in 38 of the bits
#: on average, with a deviation of 6, and unrelated texts in 128; 48 takes most of those along. Eight segments of 32 bits
#: keep chance matches rare (of n fingerprints, about n / 2**32 for each look-up) and find a pair of likeness 0.9 with a
#: chance of 0.94. near_copies finds the others by shingle prefixes, and verifies all on the shingle sets, so these numbers
#: decide the cost but not the result.
NEAR_COPIES = {"shingle": 5, "n_longs": 4, "segments": 8, "segment_bits": 32, "radius": 1, "max_distance": 48}
LIKENESS = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that are rejected go."""
    return without_bad_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id (null last)."""
    return one_of_each(docs, threshold=LIKENESS, **NEAR_COPIES)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that stand in an earlier document go; documents left without a word go."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their weights; a document stands as often as the mix takes it."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Token ids and fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
