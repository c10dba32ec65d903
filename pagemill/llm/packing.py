"""Hierarchical packing of token sequences into windows of several lengths.

Documents are routed to tiers by their length (full windows of the longest tier first, the rest to the smallest tier that
holds it). Each tier is packed from the longest down; what a window has left is filled with the longest document of its
own or a shorter tier that fits, at last with a piece cut from one. So every window is exactly full, and only the end of
a batch of documents leaves fewer tokens than the shortest tier: those are cut into powers of two. Windows of a tier are
then put into step groups of equal tokens, in an order that evens out their attention cost.

A batch is a bounded number of tokens of one input partition, so tasks stream through their rows: no shuffle, no group
of unbounded size, and the same input partitions give the same sequences when a lost task runs again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SegmentEncoder

#: Tokens of documents that are packed together.
BATCH_TOKENS = 1 << 21
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def pack_lengths(lengths: Sequence[int], tiers: Sequence[int] = (256, 512, 1024, 2048)) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document index, start, length); every id lies in one piece.

    Every sequence is exactly as long as a tier, or, at the end, a smaller power of two. Documents of length 0 have no
    piece. Works on the lengths of one batch.
    """
    longest, shortest = tiers[-1], tiers[0]
    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []  # (length, document, start), kept in order
    for doc, n in enumerate(lengths):
        full = n // longest
        sequences += [[(doc, k * longest, longest)] for k in range(full)]
        if n % longest:
            rest.append((n % longest, doc, full * longest))
    rest.sort()
    tokens = sum(n for n, _, _ in rest)
    for place in range(len(tiers) - 1, -1, -1):
        size, below = tiers[place], tiers[place - 1] if place else 0
        # windows of this tier are opened by its own documents; the shortest tier takes what is left
        while rest and tokens >= size and rest[-1][0] > below:
            window, room = [], size
            while room:
                at = bisect_right(rest, (room, len(lengths), 0))
                if at:
                    n, doc, start = rest.pop(at - 1)
                else:  # all are longer than the room: cut the shortest
                    n, doc, start = rest.pop(0)
                    insort(rest, (n - room, doc, start + room))
                    n = room
                window.append((doc, start, n))
                room -= n
            sequences.append(window)
            tokens -= size
    # fewer tokens than a window of their tier: powers of two, the largest first
    size = longest
    while tokens:
        size = min(size, 1 << (tokens.bit_length() - 1))
        window, room = [], size
        while room:
            n, doc, start = rest.pop()
            if n > room:
                insort(rest, (n - room, doc, start + room))
                n = room
            window.append((doc, start, n))
            room -= n
        sequences.append(window)
        tokens -= size
    return sequences


def step_groups(sequences: Sequence[Sequence[tuple[int, int, int]]], step_tokens: int) -> list[int]:
    """A group number for each sequence. A group holds sequences of one length, up to step_tokens together.

    Within a length, sequences in order of attention cost (sum of squared piece lengths) are dealt to its groups there
    and back, so that groups cost alike.
    """
    by_length: dict[int, list[tuple[int, int]]] = {}
    for k, pieces in enumerate(sequences):
        by_length.setdefault(sum(p[2] for p in pieces), []).append((sum(p[2] ** 2 for p in pieces), k))
    groups, first = [0] * len(sequences), 0
    for length in sorted(by_length, reverse=True):
        dealt = sorted(by_length[length])
        n = -(-len(dealt) * length // step_tokens)
        for place, (_, k) in enumerate(dealt):
            turn, at = divmod(place, n)
            groups[k] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: Sequence[int] = (256, 512, 1024, 2048), step_tokens: int = 32_768, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its text's ids (null: empty) and end_id, so an empty text has one id. tier is the sequence's length.
    sequence_id and step_group are distinct over the table: the partition's number, the batch's and the place in it.
    Repeated rows are packed as documents of their own. A null id stays null. Documents of one length are taken in the
    order of the partition's rows. A text of any length is cut into pieces. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SegmentEncoder.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        tokens, turn = 0, 0

        def flush() -> pa.RecordBatch:
            base = (TaskContext.get().partitionId() << 40) + (turn << 24)
            sequences = pack_lengths([len(ids) // 4 for _, ids in held], tiers)
            groups = step_groups(sequences, step_tokens)
            rows = []
            for k, pieces in enumerate(sequences):
                offset, length = 0, sum(p[2] for p in pieces)
                for doc, start, n in pieces:
                    key, ids = held[doc]
                    rows.append((key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + k, offset, length, base + groups[k]))
                    offset += n
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1), end), strict=True):
                held.append((key, ids))
                tokens += len(ids) // 4
                if tokens >= batch_tokens:
                    yield flush()
                    held, tokens, turn = [], 0, turn + 1
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)
