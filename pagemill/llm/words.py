"""Words of a block of texts, found in its bytes with numpy and numbered by Arrow: no Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of texts that are taken together (or one text, if it is longer).
BLOCK_BYTES = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, end to end, and where each text starts (and the last ends)."""
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
    return data, (places - places[0]).astype(np.int64)


def blocks_of(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of an array of texts of about size bytes, or one text each; null becomes the empty text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = text_views(texts)[1][1:]
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, upto - at)
        at = upto


def numbered_words(texts: pa.Array, dropped: bytes = b"", lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, numbers, counts) of an array of texts without nulls: XXH3 of each distinct word, A-Z in lower case
    unless lower is false; all words end to end, by their place among those; how many words each text has. Words are cut at ASCII white space; the
    characters of dropped are left out, and words that have no others."""
    data, places = text_views(texts)
    space = _SPACE[data]
    solid = ~space
    if dropped:
        out = np.zeros(256, bool)
        out[list(dropped)] = True
        solid &= ~out[data]
    space[places[:-1][places[:-1] < len(data)]] = True  # here: the start of a text parts words too
    kept = np.flatnonzero(solid).astype(np.int32)
    turn = np.cumsum(space, dtype=np.int32)[kept]
    fresh = np.ones(len(kept), bool)
    fresh[1:] = turn[1:] != turn[:-1]
    first = np.flatnonzero(fresh).astype(np.int32)
    cuts = np.append(first, np.int32(len(kept)))
    bare = _LOWER[data[solid]] if lower else data[solid]
    del turn, fresh, space, solid
    found = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(bare)]).dictionary_encode()
    names = found.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return hashes, found.indices.to_numpy(), np.diff(np.searchsorted(kept[first], places))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles_of(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """For each text of an array the 64-bit hashes of its shingles, in order, repeats included; null is the empty text.

    Fewer words than a shingle: the whole sequence is the only one; no words: none.
    """
    step = np.uint64(0x9E3779B97F4A7C15)
    for block in blocks_of(texts):
        hashes, numbers, counts = numbered_words(block)
        words = hashes[numbers]
        runs = words.copy()
        with np.errstate(over="ignore"):
            for j in range(1, shingle):
                runs[:-j] = runs[:-j] * step + words[j:]
        runs = mixed(runs)
        ends = np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= shingle:
                yield runs[end - n : end - shingle + 1]
            else:
                yield np.array([hash_of_few(words[end - n : end])] * (n > 0), np.uint64)


def hash_of_few(words: np.ndarray) -> int:
    """The hash of a text of fewer words than a shingle; their number is part of it."""
    return xxhash.xxh3_64_intdigest(words.tobytes())
