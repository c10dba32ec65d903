"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted documents are dealt into two folds by a hash of their ids. The model is fitted on all of one, and gives each
document's perplexity. A document is kept if its perplexity is at most a quantile of its language's trusted documents of
the other fold: a threshold from documents that the model has seen would be too low.

Texts are taken in chunks of a bounded number of bytes (katz.chunks). A chunk's distinct words are joined to the table of
words; its distinct pairs and trigrams are sent as sorted blocks of 64-bit keys to the shards of the key space, whose counts
answer in the order of the block. So keys are spread evenly, however common a word or a pair is. In fitting, a shard tells
one chunk of each trigram (then pair) that it owns it, and that chunk, which knows its words, hands its count on to the lower
orders.

Documents are scored in rounds, each a part of them against all of the model, and what a round wrote is deleted after it:
what is on disk at a time is the model, and a round's share of the n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import WORD, n_written, remove_written, written
from .katz import END, START, _pack, _squeeze, _unpack, _unsqueeze, chunks, pair_keys, shard_edges

#: About how many trusted documents of a language the model is fitted on at most; none: the whole fold.
TRAIN_DOCS: int | None = None
BROADCAST_ROWS = 2_000_000
#: A document is kept up to this quantile of its language's trusted documents, with some room above.
QUANTILE, ROOM = 0.99, 1.1
#: A language's threshold is a mean of its own quantile and that of all languages, which counts as so many documents.
PRIOR_DOCS = 30
#: Longest text a document may have to be fitted on; none: of any length.
TRAIN_CHARS: int | None = None
#: Bytes of text for each shard of the key space.
SHARD_BYTES = 6 << 20
#: Documents are scored in rounds of about this many bytes of text, in ROUNDS at most, as each reads the model anew.
ROUND_BYTES, ROUNDS = 24 << 20, 6
#: A chunk closes at this many bytes of text.
CHUNK_BYTES = 4 << 20
OOV_KEY = np.uint64(xxhash.xxh3_64_intdigest(b"\n unknown") & ~1 & (1 << 64) - 1)
_as_long = lambda k: int(k.astype(np.int64))
OOV, PAD = _as_long(OOV_KEY), pair_keys(START, START)
END_KEY, START_KEY, END, START = END, START, _as_long(END), _as_long(START)  # words have no white space, so none is one of these


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of counts (c), as Chen and Goodman have them: r - (r + 1) y n(r + 1) / n(r), y = n(1) / (n(1) + 2 n(2)).

    The counts of counts n(1) to n(4) are smoothed by a line, log n(r) = a + b log r, by least squares over those that are
    not 0 (at most 0; -2 where fewer than two are there), so that D(r) lies between 0 and r in a corpus of any size.
    """
    return _discounts({row["c"]: row["count"] for row in counts.where("c between 1 and 4").groupBy("c").count().collect()})  # four rows at most


def _discounts(n: dict[int, int]) -> list[float]:
    points = [(math.log(r), math.log(k)) for r, k in n.items()]
    b = -2.0
    if len(points) > 1:
        mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
        b = min(sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points), 0.0)
    y = 1 / (1 + 2 * 2**b)
    return [r - (r + 1) * y * ((r + 1) / r) ** b for r in (1, 2, 3)]


def _discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


class Grams:
    """Tokens of a chunk with unknown words made OOV, its distinct pairs and trigrams in order, and where among them they stand.

    A token's own pair is the word before and itself; its history is the pair of the two words before.
    """

    def __init__(self, row: dict, *only: str):
        vocabulary, words, self.sizes = _unsqueeze(row["vocabulary"]), _unpack(row["words"]), _unpack(row["sizes"])
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(vocabulary)).astype(bool)
        #: keys of the vocabulary, and last the start; w and v are each token and the one before as places in it
        self.names = np.append(np.where(self.known, vocabulary, OOV_KEY), START_KEY)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.w = words

        def shifted(x: np.ndarray, first: int | np.uint64) -> np.ndarray:
            x = np.roll(x, 1)
            x[self.starts] = first
            return x

        self.v = shifted(words, len(vocabulary))
        pair = pair_keys(self.names[self.v], self.names[words])
        triple = pair_keys(shifted(pair, PAD), self.names[words])
        if only:  # the keys of either alone; a plain sort is several times as fast as one that tells places
            keys = np.sort(triple if only == ("triples",) else np.append(pair, PAD))
            self.triples = self.pairs = keys[np.append(True, keys[1:] != keys[:-1])]
            return
        self.triples, self.triple = np.unique(triple, return_inverse=True)
        self.pairs, at = np.unique(np.append(pair, PAD), return_inverse=True)
        self.pair, self.history = at[:-1], shifted(at[:-1], at[-1])


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.Table.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=list(names))


def _blocks(chunk: int | None, keys: np.ndarray, values: np.ndarray, shards: int) -> list[tuple]:
    """(shard, chunk, keys, values) for each shard that has some of the sorted keys; values has a row for each kind of value."""
    cuts = [0, *np.searchsorted(keys, shard_edges(shards)).tolist(), len(keys)]
    return [(n, chunk, _squeeze(keys[x:y]), _pack(values[:, x:y].ravel())) for n, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]


def _values(data: bytes, kinds: int) -> np.ndarray:
    return _unpack(data).reshape(kinds, -1)


def _answered(answered: pa.Table, kinds: int) -> np.ndarray:
    """The answers of all shards, in their order: values in the order of the keys that were asked for."""
    found = sorted(zip(answered.column("shard").to_pylist(), answered.column("values").to_pylist(), strict=True))
    return np.concatenate([_values(v, kinds) for _, v in found], axis=1)


BLOCKS = "shard int, chunk long, keys binary, values binary"


def _mapped(made: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """Chunks with the words that are known (one bit each), and with the columns p, back and n of words (w, p, back, n) for these."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, vocabulary in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = _unsqueeze(vocabulary).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), chunk)), pa.array(w)], names=["chunk", "w"])

    def run(key: tuple, made: pa.Table, found: pa.Table) -> pa.Table:
        vocabulary = _unsqueeze(made.column("vocabulary")[0].as_py())
        w = found.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        known = np.zeros(len(vocabulary), bool)
        known[np.searchsorted(vocabulary, w)] = True
        for name in ("p", "back", "n"):
            numbers = found.column(name).to_numpy()[order].astype("<f8").tobytes()
            made = made.append_column(name, pa.array([zstandard.ZstdCompressor(level=1).compress(numbers)], pa.binary()))
        return made.append_column("known", pa.array([np.packbits(known).tobytes()], pa.binary()))

    found = made.select("chunk", "vocabulary").mapInArrow(listed, "chunk long, w long").join(_small(words, n_words), "w")
    schema = StructType(list(made.schema.fields)).add("p", "binary").add("back", "binary").add("n", "binary").add("known", "binary")
    return made.groupBy("chunk").cogroup(found.select("chunk", "w", "p", "back", "n").groupBy("chunk")).applyInArrow(run, schema)


def _each_chunk(made: DataFrame, body: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """The rows that body gives for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                (row,) = b.slice(k, 1).to_pylist()
                yield from _rows(body(row), schema).to_batches()

    return made.drop("ids").mapInArrow(run, schema)


def _each_answered(made: DataFrame, answered: DataFrame, body: Callable[[dict, pa.Table], list[tuple]], schema: str) -> DataFrame:
    """The rows that body gives for each chunk and its answers."""

    def run(key: tuple, made: pa.Table, answered: pa.Table) -> pa.Table:
        return _rows(body(made.to_pylist()[0], answered), schema)

    return made.drop("ids").groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, schema)


SUMMED = "shard int, chunk long, keys binary, values binary, owned binary, stats array<long>"


def _summed(asked: DataFrame, kinds: int) -> DataFrame:
    """Blocks -> a row for each shard without a chunk: its keys, their summed values, and of the first value how many keys
    have 1, 2, 3, 4 and more than 2, and its sum; and an answer to each block: the first value in the order of its keys, and
    a bit for each key that the chunk owns."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, found = key[0].as_py(), sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "keys", "values")), strict=True))
        blocks = [_unsqueeze(k) for _, k, _ in found]
        flat = np.concatenate([_values(v, kinds) for _, _, v in found], axis=1)
        keys, first, place = np.unique(np.concatenate(blocks), return_index=True, return_inverse=True)
        total = np.stack([np.bincount(place, v, len(keys)) for v in flat]).astype(np.int64)
        owned = np.zeros(len(place), bool)
        owned[first] = True
        stats = [*(int((total[0] == r).sum()) for r in (1, 2, 3, 4)), int((total[0] > 2).sum()), int(total[0].sum())]
        rows, at = [(shard, None, _squeeze(keys), _pack(total.ravel()), None, stats)], 0
        for (chunk, _, _), block in zip(found, blocks, strict=True):
            part = slice(at, at + len(block))
            rows.append((shard, chunk, None, _pack(total[0][place[part]]), np.packbits(owned[part]).tobytes(), None))
            at += len(block)
        return _rows(rows, SUMMED)

    return asked.groupBy("shard").applyInArrow(run, SUMMED)


def _owned(answered: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk's keys: the total, and whether the chunk owns the key."""
    found = sorted(zip(*(answered.column(c).to_pylist() for c in ("shard", "values", "owned")), strict=True))
    counts = [_unpack(v) for _, v, _ in found]
    bits = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(c)) for (_, _, o), c in zip(found, counts, strict=True)]
    return np.concatenate(counts), np.concatenate(bits).astype(bool)


def _cut(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def fit(trusted: DataFrame, text_col: str = "text") -> dict[str, DataFrame | int | list[float]]:
    """trusted texts -> the model's tables.

    words (w, p, back, n): interpolated unigram probability (continuation counts), the weight it has after w, and the
    count of pairs that begin with w; pairs and triples: a row (shard, keys, values, ...) for each shard of the key space, with
    the counts of its n-grams in the order of their keys. Those of pairs are continuation counts, then what the pair is followed
    by (tokens, and types seen once, twice, more often); q is what the shard's pairs keep after discounts. discounts: D1 to
    D3+ of pairs, and of trigrams. shards: how many parts the key space has.
    Words seen once are unknown (OOV); oov_types is their number, over which the probability of OOV is spread. Null texts
    count as empty ones, repeated rows as texts of their own; no texts give empty tables.
    """
    spark, mark = trusted.sparkSession, n_written(trusted.sparkSession)
    with _shuffles_deleted(spark):
        made = written(chunks(trusted.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), CHUNK_BYTES, lower=False), "chunks")
        shards = _bytes(trusted, text_col) // SHARD_BYTES + 1

        def counted(row: dict) -> list[tuple]:
            words = _unsqueeze(row["vocabulary"]).view(np.int64)
            return list(zip(words.tolist(), np.bincount(_unpack(row["words"]), minlength=len(words)).tolist(), strict=True))

        types = written(_each_chunk(made, counted, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "types")
        vocab = types.where((F.col("n") > 1) | (F.col("w") == END)).select("w", *[F.lit(0.0).alias(c) for c in ("p", "back", "n")])
        n_words = vocab.count()
        oov_types = types.count() - n_words
        mapped = written(_mapped(made, vocab, n_words), "mapped")

        def asked(row: dict) -> list[tuple]:
            g = Grams(row)
            return _blocks(row["chunk"], g.triples, np.bincount(g.triple)[None], shards)

        triples = written(_summed(_each_chunk(mapped, asked, BLOCKS), 1), "triples")

        def pairs_of(row: dict, answered: pa.Table) -> list[tuple]:
            g, (c, owned) = Grams(row), _owned(answered)
            at = np.empty(len(g.triples), np.int64)
            at[g.triple] = np.arange(len(g.triple))
            at, c = at[owned], c[owned]
            # lower orders count the distinct words before; after a start there is no word before, so those keep their counts
            one = np.where(g.v[at] == len(g.names) - 1, c, 1)
            values = [np.bincount(g.pair[at], one, len(g.pairs))] + [np.bincount(g.history[at], x, len(g.pairs)) for x in (c, c == 1, c == 2, c > 2)]
            return _blocks(row["chunk"], g.pairs, np.stack(values).astype(np.int64), shards)

        answers = lambda df: df.where("chunk is not null").select("shard", "chunk", "values", "owned")
        pairs = written(_summed(_each_answered(mapped, answers(triples), pairs_of, BLOCKS), 5), "pairs")

        def words_of(row: dict, answered: pa.Table) -> list[tuple]:
            g, (c, owned) = Grams(row), _owned(answered)
            at = np.full(len(g.pairs), -1)
            at[g.pair] = np.arange(len(g.pair))
            mine = owned & (c > 0) & (at >= 0)
            at, c, n = at[mine], c[mine], len(g.names)
            values = [np.bincount(g.w[at], minlength=n)] + [np.bincount(g.v[at], x, n).astype(np.int64) for x in (c, c == 1, c == 2, c > 2)]
            some = np.flatnonzero((values[0] > 0) | (values[1] > 0))
            return list(zip(g.names[some].astype(np.int64).tolist(), *(v[some].tolist() for v in values), strict=True))

        rows = _each_answered(mapped, answers(pairs), words_of, "w long, c long, n long, n1 long, n2 long, n3 long")
        singles = written(rows.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("c", "n", "n1", "n2", "n3")]), "singles")

        def of(df: DataFrame) -> list[float]:
            found = df.where("stats is not null").agg(*[F.sum(F.get("stats", F.lit(k))) for k in range(4)]).first()
            return _discounts({r: k for r, k in enumerate(found, 1) if k})

        d1, d2, d3 = discounts(singles), of(pairs), of(triples)
        total = singles.where("c > 0").agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"), d1)).alias("cut")).first()
        n, cut = float(total["total"] or 1), float(total["cut"] or 1)
        uniform = cut / n / (n_words + 1)
        p = F.when(F.col("c") > 0, (F.col("c") - _discount(F.col("c"), d1)) / n).otherwise(0.0) + uniform
        back = F.when(F.col("n") > 0, sum(F.col(f"n{k}") * x for k, x in enumerate(d2, 1)) / F.col("n")).otherwise(1.0)
        words = written(singles.select("w", p.alias("p"), back.alias("back"), F.col("n").cast("double").alias("n")), "words")
    stat = lambda k: F.get("stats", F.lit(k))
    kept = (stat(5) - stat(0) * d2[0] - stat(1) * d2[1] - stat(4) * d2[2]).alias("q")
    tables = {"triples": triples.where("chunk is null").select("shard", "keys", "values"), "pairs": pairs.where("chunk is null").select("shard", "keys", "values", kept)}
    remove_written(spark, mark, keep_last=4)
    return {"words": words, **tables, "oov_types": oov_types, "discounts": [d2, d3], "shards": shards}


def perplexities(docs: DataFrame, model: dict[str, DataFrame | int | list[float]], by: list[str], text_col: str = "text") -> DataFrame:
    """(by..., n_tokens, perplexity), a row for each distinct by; texts with the same by count as one.

    A null text is one end. Nulls in by are values like any other. An empty table gives no rows.
    """
    spark, words = docs.sparkSession, model["words"]
    d2, d3 = model["discounts"]
    n_words, spread = words.count(), 1 / (model["oov_types"] + 1)
    fixed = {r["w"]: (float(r["p"]), float(r["back"]), float(r["n"])) for r in words.where(F.col("w").isin(OOV, START)).collect()}
    rare = (float(words.agg(F.min("p")).first()[0] or 1.0), 1.0, 0.0)
    oov, start = fixed.get(OOV, rare), fixed.get(START, rare)
    size = _bytes(docs, text_col)
    rounds = min(ROUNDS, size // ROUND_BYTES + 1)
    finer = size // rounds // (model["shards"] * SHARD_BYTES) + 1
    shards = model["shards"] * finer

    def table(name: str, kinds: int) -> DataFrame:
        """The model's table, its shards cut up where a round has much more text than the model was fitted on."""

        def run(row: dict) -> list[tuple]:
            return [(s, keys, values) for s, _, keys, values in _blocks(None, _unsqueeze(row["keys"]), _values(row["values"], kinds), shards)]

        found = model[name].select("shard", "keys", "values")
        return found if finer == 1 else _each_chunk(found, run, "shard int, keys binary, values binary")

    def looked_up(name: str, kinds: int, mapped: DataFrame) -> DataFrame:
        def asked(row: dict) -> list[tuple]:
            keys = getattr(Grams(row, name), name)
            return [block[:3] for block in _blocks(row["chunk"], keys, np.zeros((0, len(keys))), shards)]

        def run(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
            keys, values = np.zeros(1, np.uint64), np.zeros((kinds, 1), np.int64)  # what is not found is 0
            for k, v in zip(table.column("keys").to_pylist(), table.column("values").to_pylist(), strict=True):
                keys, values = np.append(_unsqueeze(k), keys), np.append(_values(v, kinds), values, axis=1)
            rows = []
            for chunk, block in zip(asked.column("chunk").to_pylist(), asked.column("keys").to_pylist(), strict=True):
                block = _unsqueeze(block)
                at = np.searchsorted(keys[:-1], block)
                at[keys[at] != block] = len(keys) - 1
                rows.append((key[0].as_py(), chunk, _pack(values[:, at].ravel())))
            return _rows(rows, "shard int, chunk long, values binary")

        blocks = _each_chunk(mapped, asked, BLOCKS.rsplit(", ", 1)[0])
        return table(name, kinds).groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(run, "shard int, chunk long, values binary").withColumn("kinds", F.lit(kinds))

    result = StructType([*docs.select(*by).schema.fields, StructField("n_tokens", LongType()), StructField("logs", DoubleType())])

    def scored(key: tuple, made: pa.Table, answered: pa.Table) -> pa.Table:
        row = made.drop(["ids"]).to_pylist()[0]
        g = Grams(row)
        (c3,), (c2, n, n1, n2, n3) = (_answered(answered.filter(pc.field("kinds") == kinds), kinds) for kinds in (1, 5))
        p, back, n_v = (np.full(len(g.names), oov[k]) for k in range(3))
        for k, (name, column) in enumerate((("p", p), ("back", back), ("n", n_v))):
            column[:-1][g.known] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row[name]), "<f8")
            column[-1] = start[k]
        back2 = np.where(n > 0, (n1 * d3[0] + n2 * d3[1] + n3 * d3[2]) / np.maximum(n, 1), 1.0)
        p2 = (c2 - _cut(c2, d2))[g.pair] / np.maximum(n_v[g.v], 1) + back[g.v] * p[g.w]
        p3 = (c3 - _cut(c3, d3))[g.triple] / np.maximum(n[g.history], 1) + back2[g.history] * p2
        one_of = np.where(g.names == OOV_KEY, spread, 1.0)[g.w]
        ids = made.column("ids").combine_chunks().flatten()
        columns = [ids.field(k) for k in range(len(by))]
        return pa.Table.from_arrays([*columns, pa.array(g.sizes), pa.array(np.add.reduceat(np.log(p3 * one_of), g.starts))], names=result.names)

    rows, parts = docs.select(F.struct(*by).alias("id"), F.col(text_col).alias("text")), []
    with _shuffles_deleted(spark):
        for turn in range(rounds):
            mark = n_written(spark)
            made = written(chunks(rows.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn), CHUNK_BYTES, lower=False), "chunks")
            mapped = written(_mapped(made, words, n_words), "mapped")
            remove_written(spark, mark, keep_last=1)
            # one after the other, as each sends its table of the model
            answered = [written(looked_up(name, kinds, mapped), name) for name, kinds in (("triples", 1), ("pairs", 5))]
            parts.append(written(mapped.groupBy("chunk").cogroup(answered[0].unionAll(answered[1]).groupBy("chunk")).applyInArrow(scored, result), "scores"))
            remove_written(spark, mark, keep_last=1)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found.groupBy(*by).agg(F.sum("n_tokens").alias("n_tokens"), F.exp(-F.sum("logs") / F.sum("n_tokens")).alias("perplexity"))


def sample_of(ids: DataFrame, by: str, most: int, seed: int) -> DataFrame:
    """At most about `most` rows for each value of by, chosen by a hash of the id: the same rows every time."""
    share = ids.groupBy(by).agg((F.lit(float(most)) / F.count("*")).alias("share")).withColumnRenamed(by, "_by")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    return ids.join(share, F.col(by).eqNullSafe(F.col("_by"))).where(draw < F.col("share")).drop("_by", "share")


def classify(docs: DataFrame, labels: DataFrame, train_docs: int | None = TRAIN_DOCS) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, kept) for each row of docs (doc_id, text, lang).

    labels (doc_id, quality): trusted documents have quality 1. Half of them (by a hash of the id) are fitted on; all that are
    not fitted on set the thresholds. train_docs bounds the former, by default nothing does. Null text has no words: only its end is
    scored. A null lang is a language of its own. A language's threshold is drawn towards that of all languages, the more
    the fewer documents it has. Ties with the threshold are kept. An empty table gives no rows.
    Rows equal in doc_id, text and lang have one result, repeated. With no text to fit on all documents are kept, without
    a threshold.
    """
    mark = n_written(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    key = F.xxhash64("doc_id", "text", "lang")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    small = docs.where("text is not null") if TRAIN_CHARS is None else docs.where(F.length("text") <= TRAIN_CHARS)
    half = small.join(good, "doc_id", "left_semi").where(F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(2)) == 0)
    some = half.select("doc_id", "lang") if train_docs is None else sample_of(half.select("doc_id", "lang"), "lang", train_docs, 12)
    chosen = written(some.select("doc_id").distinct(), "fold")
    if chosen.isEmpty():
        n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        return docs.select("doc_id", "lang", n.alias("n_words"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    fitted = small.join(_small(chosen, chosen.count()), "doc_id", "left_semi")
    model = fit(fitted)
    scored = written(perplexities(docs.select("doc_id", "lang", "text", key.alias("key")), model, ["doc_id", "lang", "key"]), "perplexities")
    ranked = scored.join(good, "doc_id", "left_semi").join(fitted.select(key.alias("key")).distinct(), "key", "left_anti").select("lang", "perplexity")
    cut = F.percentile_approx("perplexity", QUANTILE, 10_000) * ROOM
    overall = F.lit(ranked.agg(cut.alias("cut")).first()["cut"]).cast("double")
    own = (F.col("n") * F.col("own") + PRIOR_DOCS * overall) / (F.col("n") + PRIOR_DOCS)
    by_lang = ranked.groupBy("lang").agg(cut.alias("own"), F.count("*").alias("n")).select(F.col("lang").alias("_l"), own.alias("own"))
    by_lang = written(by_lang, "thresholds")
    remove_written(docs.sparkSession, mark, keep_last=2)
    result = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")), "left")
    threshold = F.coalesce("own", overall)
    result = result.select("key", F.col("n_tokens").alias("n"), "perplexity", threshold.alias("threshold"))
    # rows equal in all three share a key and were scored together: divide their tokens, and repeat the row
    times = docs.select("doc_id", "lang", key.alias("key"))
    copies = times.groupBy("key").agg(F.count("*").alias("copies"))
    joined = times.join(result.join(copies, "key"), "key")
    return joined.select("doc_id", "lang", (F.col("n") / F.col("copies") - 1).cast("long").alias("n_words"), "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
