"""Token ids and token counts of whole texts, exactly as the tokenizers library gives them.

Encoding a text through the library is slow, because it tracks offsets for every character; prose repeats its words. So
texts are cut into segments, at points where the tokenizer's own pre-tokenizer always cuts: before white space, and
between a Latin letter and an ASCII mark or digit after it. The cuts of a block of texts are found in its bytes with numpy,
Arrow numbers the distinct segments, and only those are encoded (by the library, once per worker as long as a bounded
cache holds them); the ids of the texts are then taken by number, without a Python step for each word.

Which cuts are safe is known for the two kinds of file this module takes: byte-level BPE with the GPT-2 pattern, and
BPE with word ends that drops white space. Texts with unusual characters or the text of a special token go through the
library as a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import text_bytes
from .words import blocks_of, text_views

#: Segments that a worker keeps; when full, it starts anew.
CACHE_SEGMENTS = 300_000
#: The pre-tokenizer pattern of byte-level BPE, as in the tokenizer's public definition.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments longer than this (in characters) are encoded anew each time.
CACHE_CHARS = 64
#: Ranges of characters whose properties all regular expression libraries share; texts with others go to the library as a whole.
KNOWN = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC))
OTHER = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in KNOWN) + "]")
OTHER_RE2 = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in KNOWN) + "]"
#: A word of plain Latin letters with the white space before it.
PLAIN_SEGMENT = re.compile(r"(\s*)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of byte-level BPE: printable Latin-1 stands for itself, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


ALPHABET = byte_alphabet()


def as_bytes(text: str) -> str:
    """A text as the BPE model sees it: a character for each byte."""
    return text.encode().decode("latin-1").translate(ALPHABET)


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))


def _bytes_in(*chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list("".join(chars).encode())] = True
    return found


SPACE = _bytes_in(" \t\n\r")
LETTER = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MARK = np.zeros(256, bool)  # ASCII that is neither letter nor white space
MARK[0x21:0x7F] = ~LETTER[0x21:0x7F]
#: Second bytes of the letters from U+00C0 to U+00FF: all but the signs for times and divided by.
LATIN_1 = np.zeros(256, bool)
LATIN_1[0x80:0xC0] = True
LATIN_1[[0x97, 0xB7]] = False


def segments(data: np.ndarray, places: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts (as from text_views) as one array of segments without a copy, and each text's first segment (and the end).

    A segment starts where a text does, at white space after other bytes, and at an ASCII mark or digit after a letter.
    """
    starts = np.zeros(len(data), bool)
    space = SPACE[data]
    letter = LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & LATIN_1[data[1:]]
    starts[1:] = (space[1:] & ~space[:-1]) | (MARK[data[1:]] & letter[:-1])
    starts[places[:-1][places[:-1] < len(data)]] = True
    cuts = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
    return found, np.searchsorted(cuts[:-1], places)


class SegmentEncoder(dict):
    """segment -> ids as little-endian unsigned 32-bit numbers; the library is asked for what is missing."""

    def __init__(self, path: str):
        super().__init__()
        self.tok, self.special = tokenizer(path), _special(path)
        self.bpe = self.tok.model.tokenize
        #: the kind that lowers case and drops white space
        self.drops_space = self.tok.normalizer is not None

    @staticmethod
    @lru_cache(maxsize=4)
    def of(path: str) -> SegmentEncoder:
        return SegmentEncoder(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a pre-token of plain letters, maybe after one space."""
        seen = word.replace(" ", ALPHABET[32]) if word.isascii() else as_bytes(word)
        return array("I", [t.id for t in self.bpe(seen)]).tobytes()

    def __missing__(self, segment: str) -> bytes:
        cut = PLAIN_SEGMENT.fullmatch(segment)
        if cut is None:
            ids = self.whole(segment)
        elif self.drops_space:
            ids = self._word(cut[2].lower())
        elif len(cut[1]) < 2 and cut[1] in " ":
            ids = self._word(segment)
        else:
            # of white space before a word, the last character is apart: a space goes with the word, another stands alone
            first, last = cut[1][:-1], cut[1][-1]
            ids = (self[first] if first else b"") + (self._word(" " + cut[2]) if last == " " else self[last] + self._word(cut[2]))
        if len(segment) <= CACHE_CHARS:
            if len(self) >= CACHE_SEGMENTS:
                self.clear()
            self[segment] = ids
        return ids

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> Iterator[bytes]:
        """The ids of each text, with end after them; null is the empty text."""
        for block in blocks_of(texts):
            odd = pc.match_substring_regex(block, OTHER_RE2)
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(block, s))
            found, first = segments(*text_views(block))
            numbered = found.dictionary_encode()
            known = [self[s] for s in numbered.dictionary.to_pylist()] if not pc.all(odd).as_py() else []
            sizes, flat = np.fromiter(map(len, known), np.int64, len(known)), np.frombuffer(b"".join(known), np.uint8)
            at = np.cumsum(sizes) - sizes
            which = numbered.indices.to_numpy()
            del found, numbered, known
            for k, is_odd in enumerate(odd.to_pylist()):
                if is_odd:
                    yield self.whole(block[k].as_py()) + end
                else:
                    own = which[first[k] : first[k + 1]]
                    n = sizes[own] >> 2
                    ends = np.cumsum(n)
                    places = np.repeat((at[own] >> 2) - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                    yield flat.view("<u4")[places].tobytes() + end

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


def whole_tokens(path: str) -> dict[str, int]:
    """Pre-token -> 1 for every string of a byte-level vocabulary that encodes alone as its one token.

    This is the proof offline: each vocabulary entry is turned back into text and encoded by the library; merges can
    lead elsewhere, bytes may be no text, and special tokens are not pre-tokens, so not every entry passes.
    """
    tok = tokenizer(path)
    vocab = tok.get_vocab(with_added_tokens=False)
    back = {c: b for b, c in ALPHABET.items()}
    texts = {}
    for entry, token in vocab.items():
        try:
            texts[bytes(back[c] for c in entry).decode()] = token
        except (KeyError, UnicodeDecodeError):
            continue
    names = list(texts)
    found = tok.encode_batch_fast(names, add_special_tokens=False)
    return {s: 1 for s, e in zip(names, found, strict=True) if e.ids == [texts[s]] and regex.fullmatch(BYTE_LEVEL_PATTERN, s)}


_COUNTERS: dict[str, TokenCounter] = {}


class TokenCounter(dict):
    """pre-token -> number of tokens: 1 for whole tokens, merged by the library for the rest."""

    def __init__(self, path: str, whole: dict[str, int]):
        super().__init__(whole)
        self.whole_table, self.tok, self.special = whole, tokenizer(path), _special(path)
        self.find = regex.compile(BYTE_LEVEL_PATTERN).findall

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_SEGMENTS + len(self.whole_table):
            self.clear()
            self.update(self.whole_table)
        n = self[token] = len(self.tok.model.tokenize(as_bytes(token)))  # a pre-token is merged as it is
        return n

    @staticmethod
    def of(path: str, whole: Broadcast) -> TokenCounter:
        """The worker's own, kept from task to task."""
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path, whole.value)
        return _COUNTERS[path]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special) or OTHER.search(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.find(text)))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs, in one pass without a shuffle; null text is empty.

    The table of whole tokens is made once on the driver (at most the vocabulary, so of bounded size) and sent along.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(path, whole)
        for b in batches:
            texts = b.column(1)
            n = [counter.count(t.as_py()) for t in texts]
            size = [len(text_bytes(t.as_py())) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
