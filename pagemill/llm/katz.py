"""Katz back-off language model: Good-Turing discounted bigram counts with exactly normalised back-off weights.

    P(w | v) = c*(v w) / c(v)        if the training texts have v w; c* is the discounted count
             = alpha(v) * P(w)       if not
    P(w)     = c*(w) / N, and what is left over for all unknown words together
    alpha(v) = (1 - sum of P(w | v) over the w seen after v) / (1 - sum of P(w) over the same w)

A table of all bigrams grows with the corpus, so it is neither broadcast nor joined token by token. Texts are taken in
chunks of a bounded number of bytes; a chunk is cut into tokens once, which are written as numbers of its own vocabulary.
It asks for each distinct word and bigram once, in sorted blocks of 64-bit keys, one for each shard of the key space.
The shards are the model's partitioned count tables, of a bounded share of the corpus each: a shard adds up the counts of
all chunks for its keys and answers every chunk in the order of its block. What moves is the distinct n-grams of each
chunk (a few bytes each), and its token numbers once, to meet the answers. Back-off weights are summed over the distinct
bigrams of the corpus (each is owned by one chunk) and are joined only to the histories of unseen bigrams.

Keys are 64-bit hashes; their lowest bit tells bigrams from words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import numbered_words, text_views

#: A chunk closes at this many bytes of text, or rows.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 1 << 16
#: Bytes of text for each shard of the key space.
SHARD_BYTES = 6 << 20
#: Good-Turing discounts hold for counts up to this; larger counts lose as much as this one does, so that every history
#: has something left for the words not seen after it.
GT_MAX = 5
END, START = (np.uint64(xxhash.xxh3_64_intdigest(s) & ~1 & (1 << 64) - 1) for s in (b"\n end", b"\n start"))  # no word has white space
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_numbers(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, words, sizes) of an array of texts without nulls: sorted even keys of the distinct words and of the end;
    the tokens of all texts end to end, as places in the vocabulary; how many tokens each text has."""
    hashes, numbers, n_words = numbered_words(texts, lower=lower)
    vocabulary, place = np.unique(np.append(hashes & ~np.uint64(1), END), return_inverse=True)
    words = np.full(len(numbers) + len(texts), place[-1], np.uint32)
    words[np.arange(len(numbers)) + np.repeat(np.arange(len(texts)), n_words)] = place[numbers]
    return vocabulary, words, n_words + 1


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of the bigrams; they are odd."""
    with np.errstate(over="ignore"):
        x = (before ^ (before >> np.uint64(29))) * _ODD + words
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def is_held_out(doc_id: int | None, folds: int = 10) -> bool:
    """crc32 of the id as text, modulo folds, is 0. A null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, compressed."""
    steps = np.diff(values, prepend=np.zeros(1, np.uint64)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


class Chunk:
    """Tokens of a chunk's texts, its distinct keys in order, and where among them its words and bigrams stand."""

    def __init__(self, ids: list[int | None], vocabulary: np.ndarray, words: np.ndarray, sizes: np.ndarray):
        self.ids, self.words, self.sizes = ids, words, sizes
        self.held = np.array([is_held_out(i) for i in ids], bool)
        self.trains = np.repeat(~self.held, sizes)
        self.starts = np.cumsum(sizes) - sizes
        #: of each token the one before, as a place in names, of which the last is the start
        self.names = np.append(vocabulary, START)
        self.before = np.empty(len(words), np.int64)
        self.before[1:] = words[:-1]
        self.before[self.starts] = len(vocabulary)
        pairs, self.pair = np.unique(pair_keys(self.names[self.before], vocabulary[words]), return_inverse=True)
        self.keys = np.sort(np.concatenate((vocabulary, pairs)))
        self.word_at, self.pair_at = np.searchsorted(self.keys, vocabulary), np.searchsorted(self.keys, pairs)

    def counts(self) -> np.ndarray:
        """Occurrences of each distinct key in the training texts."""
        out = np.zeros(len(self.keys), np.int64)
        out[self.word_at] = np.bincount(self.words[self.trains], minlength=len(self.word_at))
        out[self.pair_at] = np.bincount(self.pair[self.trains], minlength=len(self.pair_at))
        return out


def shard_edges(shards: int) -> np.ndarray:
    """First keys of the shards after the first: equal parts of the key space."""
    return (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)


def chunks(docs: DataFrame, chunk_bytes: int, lower: bool = True) -> DataFrame:
    """docs (id of any type, text) -> a row for each chunk: its ids, its vocabulary, its tokens as places in that, and its
    texts' sizes. Words are taken in lower case unless lower is false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 20
        turn, held, size = 0, [], 0

        def closed() -> pa.RecordBatch:
            ids = pa.concat_arrays([part.column(0) for part in held])
            vocabulary, words, sizes = word_numbers(pa.concat_arrays([part.column(1) for part in held]), lower)
            row = {"chunk": first + turn, "vocabulary": _squeeze(vocabulary), "words": _pack(words), "sizes": _pack(sizes)}
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=[*row, "ids"])

        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(0), pc.fill_null(b.column(1).cast(pa.string()), "")], names=["id", "text"])
            ends = text_views(b.column(1))[1][1:]
            at = 0
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                upto = min(int(np.searchsorted(ends, before + max(chunk_bytes - size, 0), "right")), at + CHUNK_ROWS - sum(p.num_rows for p in held))
                upto = max(upto, at + (not held))  # a chunk has a text at least
                if upto > at:
                    held.append(b.slice(at, upto - at))
                    size += int(ends[upto - 1] - before)
                if upto < b.num_rows:
                    yield closed()
                    turn, held, size = turn + 1, [], 0
                at = upto
        if held:
            yield closed()

    kind = docs.schema[docs.columns[0]].dataType.simpleString()
    return docs.mapInArrow(run, f"chunk long, vocabulary binary, words binary, sizes binary, ids array<{kind}>")


def chunk_of(row: dict) -> Chunk:
    return Chunk(row["ids"], _unsqueeze(row["vocabulary"]), _unpack(row["words"]), _unpack(row["sizes"]))


def requests(made: DataFrame, shards: int) -> DataFrame:
    """Chunks -> (shard, chunk, keys, counts), a block for each chunk and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shard_edges(shards)
        for b in batches:
            for k in range(b.num_rows):
                (row,) = b.slice(k, 1).to_pylist()
                chunk = chunk_of(row)
                counts = chunk.counts()
                cuts = [0, *np.searchsorted(chunk.keys, edges).tolist(), len(chunk.keys)]
                blocks = [(n, row["chunk"], _squeeze(chunk.keys[x:y]), _pack(counts[x:y])) for n, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "chunk", "keys", "counts"])

    return made.mapInArrow(run, "shard int, chunk long, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """(shard, chunk, counts, owned, stats): total counts in the order of the chunk's keys, one bit for each that it owns,
    and on the shard's first row the shard's counts of counts (words, then bigrams; 0 to GT_MAX + 1) and totals."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        order = np.argsort(np.array(chunks))
        blocks = [_unsqueeze(table.column("keys")[int(k)].as_py()) for k in order]
        counts = [_unpack(table.column("counts")[int(k)].as_py()) for k in order]
        all_keys, place = np.unique(np.concatenate(blocks), return_inverse=True)
        flat = np.concatenate(counts)
        total = np.bincount(place, flat, len(all_keys)).astype(np.int64)
        # the owner of a key: the first chunk whose training texts have it
        owner = np.full(len(all_keys), len(flat), np.int64)
        has = np.flatnonzero(flat > 0)
        np.minimum.at(owner, place[has], has)
        owned = owner[place] == np.arange(len(flat))
        stats = []
        for kind in (0, 1):
            mine = total[(all_keys & np.uint64(1)) == kind]
            stats += [*np.bincount(np.minimum(mine, GT_MAX + 2), minlength=GT_MAX + 3)[: GT_MAX + 2].tolist(), int((mine > 0).sum()), int(mine.sum())]
        rows, at = [], 0
        for n, k in enumerate(order):
            size = len(blocks[n])
            part = slice(at, at + size)
            rows.append((key[0].as_py(), chunks[int(k)], _pack(total[place[part]]), np.packbits(owned[part]).tobytes(), stats if n == 0 else None))
            at += size
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["shard", "chunk", "counts", "owned", "stats"])

    return asked.groupBy("shard").applyInArrow(run, "shard int, chunk long, counts binary, owned binary, stats array<long>")


def discounts(n: list[int]) -> np.ndarray:
    """Factors d(0) to d(GT_MAX) from counts of counts n[0] to n[GT_MAX + 1]; d(0) is unused.

    Katz' rule, d(r) = (r* / r - k) / (1 - k) with r* = (r + 1) n(r + 1) / n(r) and k = (GT_MAX + 1) n(GT_MAX + 1) / n(1),
    on counts of counts smoothed by a line: log n(r) = a + b log r, by least squares over those that are not 0. With
    b < -1 every factor lies in (0, 1); b is -1.05 at most, and -2 where fewer than two counts of counts are there.
    """
    r = np.array([k for k in range(1, GT_MAX + 2) if n[k]], float)
    b = min(np.polyfit(np.log(r), np.log([n[int(k)] for k in r]), 1)[0], -1.05) if len(r) > 1 else -2.0
    r = np.arange(1, GT_MAX + 1)
    k = (GT_MAX + 1.0) ** (b + 1)
    return np.concatenate(([1.0], ((1 + 1 / r) ** (b + 1) - k) / (1 - k)))


class Model:
    """What all tokens share: totals and discounts (a few numbers, whatever the corpus)."""

    def __init__(self, stats: list[int]):
        n = GT_MAX + 4
        words, pairs = stats[:n], stats[n:]
        self.types, self.tokens = words[-2], words[-1]
        self.d_words, self.d_pairs = discounts(words), discounts(pairs)
        few = range(1, GT_MAX + 1)
        kept = sum(words[r] * r * (1 - self.d_words[r]) for r in few) + (self.types - sum(words[r] for r in few)) * GT_MAX * (1 - self.d_words[GT_MAX])
        #: probability of all unknown words together
        self.unknown = kept / self.tokens if self.tokens else 1.0

    def discounted(self, counts: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(counts <= GT_MAX, counts * d[np.minimum(counts, GT_MAX)], counts - GT_MAX * (1 - d[GT_MAX]))

    def word(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounted(counts, self.d_words) / max(self.tokens, 1), self.unknown)


RESULT = "kind int, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, history long, beta double, mass double, n long, row long"


def evaluate(texts: DataFrame, answered: DataFrame, model: Model) -> DataFrame:
    """Rows of three kinds, by chunk. 0: a document with its scores, save for back-off weights. 1: a history with, over
    the bigrams that the chunk owns, the sum of P(w) and of the discounted counts, and (n) its own count. 2: a history of
    n unseen bigrams in a document."""

    def run(key: tuple, texts: pa.Table, answered: pa.Table) -> pa.Table:
        chunk = chunk_of(texts.to_pylist()[0])
        order = np.argsort(np.array(answered.column("shard").to_pylist()))
        parts = [_unpack(answered.column("counts")[int(k)].as_py()) for k in order]
        counts = np.concatenate(parts)
        owned = np.concatenate([np.unpackbits(np.frombuffer(answered.column("owned")[int(k)].as_py(), np.uint8), count=len(p)) for k, p in zip(order, parts, strict=True)]).astype(bool)
        # of each name its count: texts of the training set have as many starts as ends
        of_word = counts[chunk.word_at]
        of_name = np.append(of_word, of_word[np.searchsorted(chunk.names[:-1], END)])
        cw, cp, ch = of_word[chunk.words], counts[chunk.pair_at][chunk.pair], of_name[chunk.before]
        p1 = model.word(of_word)[chunk.words]
        seen = cp > 0
        kept = model.discounted(cp, model.d_pairs)
        logs = np.log10(np.where(seen, kept / np.maximum(ch, 1), p1))
        base = np.log10((of_word + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[chunk.words]
        total = lambda x: np.add.reduceat(x, chunk.starts)
        n, n_names = len(chunk.ids), len(chunk.names)
        number = (key[0].as_py() << 20) + np.arange(n)
        as_long = lambda h: np.ascontiguousarray(h).view(np.int64)
        out = [[np.zeros(n, np.int32), pa.array(chunk.ids, pa.int64()), chunk.held, chunk.sizes, total((cw > 0).astype(np.int64)), total(base), total(logs), None, None, None, None, number]]
        # each bigram of the corpus once: at a place in the chunk that owns it
        at = np.empty(len(chunk.pair_at), np.int64)
        at[chunk.pair] = np.arange(len(chunk.pair))
        at = at[owned[chunk.pair_at]]
        if len(at):
            before = chunk.before[at]
            h = np.flatnonzero(np.bincount(before, minlength=n_names))
            beta, mass = (np.bincount(before, x[at], n_names)[h] for x in (p1, kept))
            out.append([np.ones(len(h), np.int32), None, None, None, None, None, None, as_long(chunk.names[h]), beta, mass, of_name[h], None])
        miss = np.flatnonzero(~seen & (ch > 0))
        if len(miss):
            doc = np.repeat(np.arange(n), chunk.sizes)[miss]
            both, times = np.unique(doc * n_names + chunk.before[miss], return_counts=True)
            doc, h = np.divmod(both, n_names)
            out.append([np.full(len(both), 2, np.int32), None, None, None, None, None, None, as_long(chunk.names[h]), None, None, times, number[doc]])
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        tables = []
        for rows in out:
            size = len(rows[0])
            tables.append(pa.Table.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")]))
        return pa.concat_tables(tables)

    return texts.groupBy("chunk").cogroup(answered.select("shard", "chunk", "counts", "owned").groupBy("chunk")).applyInArrow(run, RESULT)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    The model learns from the rows that are not held out; scores are log10 probabilities. Words are cut at ASCII white
    space, A-Z in lower case; each text ends with an end token; null text is empty. A row with a null id is scored like
    any other. Repeated rows are texts of their own. With no training texts every word is unknown, of probability 1.
    An empty table gives no rows. chunk_bytes and shard_bytes bound a task's memory and have no influence on the result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    made = written(chunks(rows, chunk_bytes), "chunks")
    answered = written(answers(requests(made, size // shard_bytes + 1)), "answers")
    stats = answered.where("stats is not null").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)) for k in range(2 * (GT_MAX + 4))]).first()
    model = Model([int(x) for x in stats])
    found = written(evaluate(made, answered, model), "scores")
    sums = found.where("kind = 1").groupBy("history").agg(F.sum("beta").alias("beta"), F.sum("mass").alias("mass"), F.max("n").alias("c"))
    # both differences are positive: every seen bigram is discounted, and the unknown words have a share of P(w)
    alpha = sums.select(F.col("history").alias("h"), F.log10((1 - F.col("mass") / F.col("c")) / (1 - F.col("beta"))).alias("log_alpha"))
    back = found.where("kind = 2").select("row", "history", "n").join(alpha, F.col("history") == F.col("h"), "left")
    back = back.groupBy("row").agg(F.sum(F.col("n") * F.coalesce("log_alpha", F.lit(0.0))).alias("back"))
    scores = found.where("kind = 0").join(back, "row", "left")
    return scores.select("id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("back", F.lit(0.0))).alias("score"))
