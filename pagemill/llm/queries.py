"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import LEAST_DISTINCT, LEAST_WORDS, MARKS as AUDIT_MARKS, MOST_CAPITALS, audit
from .common import WORD, table
from .exact import SPACE, exact_groups
from .fim import fill_in_middle, restored
from .katz import katz_scores
from .kneser_ney import classify
from .minhash import fingerprints_with_edits
from .mixing import mix_plan
from .packing import pack
from .quality import BOILERPLATE, ENDS_WELL, MARKS, MAX_LOST, SEPARATORS, SHOUTS, quality
from .simhash import simhash_components
from .sstable import read_shards, write_shards
from .substrings import remove_repeats
from .tokens import token_counts


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, from the plan of the stream (mixing.mix_plan has the cases)."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 2048 ids (packing.pack has the cases)."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (simhash.simhash_components has the cases)."""
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with repeated spans and windows cut out of its text (substrings.remove_repeats has the cases)."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and counts of every document (quality.quality has the cases)."""
    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept")


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and likeness (minhash.fingerprints_with_edits has the cases)."""
    return fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written in shards and read back (sstable.write_shards and read_shards have the cases)."""
    folder, shards = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_shards(spark, folder, shards)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document (tokens.token_counts has the cases)."""
    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return found.withColumnRenamed("id", "doc_id")


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under the model of those that are not held out (katz.katz_scores has the cases)."""
    return katz_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document (kneser_ney.classify has the cases)."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each order of five filters keeps and removes, for each source (audit.audit has the cases)."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digest of every document's transformed text, and of the text rebuilt from it (fim.fill_in_middle has the cases)."""
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[v.alias(k) for k, v in digests.items()])


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document among equal texts, and the digest of its text (exact.exact_groups has the cases)."""
    found = exact_groups(table(spark, sf_dir, "documents"), all_hashes=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_pack_sequences, op3_simhash_near_duplicates, op4_repeated_spans, op5_quality_rules, op6_minhash_fingerprints, op7_token_shards, op8_token_counts, op9_katz_scores, op10_kneser_ney_quality, op11_filter_audit, op12_fill_in_middle, op13_exact_duplicates)}


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, $q${pattern}$q$))"


def _quality_sql() -> str:
    line_fails = f"""({_count("l", SEPARATORS)} >= 3 AND {_count("l", SEPARATORS)} * 5 >= {_count("l", WORD)}) OR regexp_matches(l, $q${BOILERPLATE}$q$)
      OR ({_count("l", WORD)} < 8 AND NOT regexp_matches(l, $q${ENDS_WELL}$q$)) OR {_count("l", SHOUTS)} * 4 >= {_count("l", WORD)}
      OR ({_count("l", MARKS)} >= 6 AND {_count("l", MARKS)} * 2 >= {_count("l", WORD)})"""
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), $q${WORD}$q$) AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, $q${WORD}$q$)) AS lines FROM documents),
    windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
                FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id),
    q AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                 {_count("text", "[#*$%&|<>]")}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(c.n, 0)::BIGINT AS n_repeat_words,
                 coalesce(list_sum(list_transform(list_filter(lines, lambda l: NOT ({line_fails})), lambda l: {_count("l", WORD)})), 0)::BIGINT AS n_left
          FROM d LEFT JOIN covered c USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words - n_left AS lost_words,
           NOT base_failed AND n_words - n_left <= {MAX_LOST}::DOUBLE * n_words AS kept
    FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)"""


def _audit_sql() -> str:
    marks = AUDIT_MARKS.decode()
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), $q${WORD}$q$) AS w FROM documents),
    lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT + 4 * (100 * {_count("text", "[A-Z]")} > {MOST_CAPITALS} * length(text))::INT
                 + 8 * regexp_matches(text, '[{marks}]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask
          FROM d LEFT JOIN lab USING (doc_id)),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
    l(f, name) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
    orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS fs
               FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    steps AS (SELECT filter_order, k::INT AS step, fs[k] AS f, coalesce(list_sum(list_transform(fs[1:k - 1], lambda x: 1 << x)), 0)::INT AS before FROM orders, range(1, 6) AS r(k)),
    states AS (SELECT part, s.before, s.f, coalesce(sum(n) FILTER (mask & (s.before | (1 << s.f)) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & s.before = 0 AND mask & (1 << s.f) <> 0), 0) AS removed,
                      coalesce(sum(n) FILTER (mask & s.before <> 0 AND mask & (1 << s.f) <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = 1 << s.f), 0) AS unique_fails,
                      coalesce(sum(good) FILTER (mask & s.before = 0 AND mask & (1 << s.f) <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & s.before = 0 AND mask & (1 << s.f) <> 0), 0) AS toxic_lost
               FROM c, (SELECT DISTINCT before, f FROM steps) s GROUP BY part, s.before, s.f)
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
    FROM steps JOIN states USING (before, f)"""


FILL_IN_MIDDLE_SQL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS s FROM documents),
    h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || s[17:24])::BIGINT % 100 AS h3, ('0x' || s[25:32])::BIGINT % 100 AS h4 FROM d),
    p AS (SELECT doc_id, text, n, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1:n], '') AS suffix,
                 CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p"""


EXACT_SQL = f"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""


#: The others work on token ids, hashes that DuckDB lacks, or models; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_quality_rules": _quality_sql(), "op11_filter_audit": _audit_sql(), "op12_fill_in_middle": FILL_IN_MIDDLE_SQL, "op13_exact_duplicates": EXACT_SQL}
