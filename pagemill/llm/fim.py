"""Fill-in-middle transformation: a text is cut at two of its units, and its end is told before its middle.

Units are runs of ASCII letters, or one other character. A block of texts becomes one array of lists of units; each unit
gets its place within its list, places give it a role (prefix, middle or suffix), and the units of a role, as lists
again, are joined to that piece of every text of the block. All steps are Arrow kernels on whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unboxed
from .words import blocks_of, text_views

#: What stands before the pieces of a transformed text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many are transformed, and how many of those tell the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """The units of each text of a block without nulls, as an array of lists."""
    data, places = text_views(texts)
    letter = _LETTER[data]
    fresh = (data & 0xC0) != 0x80  # the first byte of a character
    fresh[1:] &= ~(letter[1:] & letter[:-1])
    fresh[places[:-1][places[:-1] < len(data)]] = True  # a text's first unit is its own
    first = np.flatnonzero(fresh)
    cuts = np.append(first, len(data)).astype(np.int32)
    units = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, places).astype(np.int32)), units)


def pieces(lists: pa.ListArray, a: pa.Array, b: pa.Array) -> list[pa.Array]:
    """Of each list the units before place a, from a to b, and from b on, each joined to one text."""
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    start = pc.take(lists.offsets.slice(0, len(lists)), parent)
    ordinal = pc.subtract(pa.array(np.arange(len(units))), start.cast(pa.int64()))
    before_a, before_b = pc.less(ordinal, pc.take(a, parent)), pc.less(ordinal, pc.take(b, parent))
    n = pc.list_value_length(lists).cast(pa.int64())
    found = []
    for role, size in ((before_a, a), (pc.and_not(before_b, before_a), pc.subtract(b, a)), (pc.invert(before_b), pc.subtract(n, b))):
        ends = np.cumsum(np.append(0, size.to_numpy(zero_copy_only=False))).astype(np.int32)
        found.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.filter(units, role)), ""))
    return found


def transformed(texts: pa.Array, h: list[np.ndarray]) -> list[pa.Array]:
    """(n, form, prefix_chars, middle_chars, output) of a block of texts without nulls; h: four numbers for each text."""
    lists = unit_lists(texts)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = h[0] % (n + 1), h[1] % (n + 1)
    marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    plain = pc.or_(pc.or_(pa.array(n == 0), marked), pa.array(h[2] % 100 >= TRANSFORMED))
    suffix_first = pa.array(h[3] % 100 < SUFFIX_FIRST)
    prefix, middle, suffix = pieces(lists, pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)))
    psm, spm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""), pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    form = pc.if_else(plain, "plain", pc.if_else(suffix_first, "spm", "psm"))
    chars = lambda piece: pc.if_else(plain, None, pc.utf8_length(piece).cast(pa.int64()))
    return [pa.array(n), form, chars(prefix), chars(middle), pc.if_else(plain, texts, pc.if_else(suffix_first, spm, psm))]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """All columns of docs but the text, with n (units), form, prefix_chars, middle_chars and output (in place of columns of docs
    with such names).

    The four numbers of a document are the first 32-bit groups of SHA-256 of seed, a colon and its id, so every run cuts
    it alike; a null id counts as no digits. Form is plain (output is the text, the lengths are null) for texts without a
    unit or with one of the three marks in them, and for 10 of 100 others; spm for 20 of 100 of what is left (suffix,
    prefix, middle), psm otherwise (prefix, suffix, middle). A null text is the empty one. Rows are told each for itself,
    so repeated ones do not matter; an empty table gives no rows. A text is taken whole, however long; a block holds some
    2 MB of texts, or one.
    """
    others = [c for c in docs.columns if c != text_col]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), numbers.alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in blocks_of(batch.column(2)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                h = np.asarray(part.column(1).flatten(), np.int64).reshape(len(texts), 4)
                yield pa.RecordBatch.from_arrays([part.column(0), *transformed(texts, list(h.T))], names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return unboxed(made, others, **{c: F.col(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")})


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. No mark can arise where a piece meets a mark, so each stands once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = form == "psm"
    return F.when(form == "plain", output).otherwise(F.concat(F.get(parts, F.when(psm, 1).otherwise(2)), F.get(parts, F.lit(3)), F.get(parts, F.when(psm, 2).otherwise(1))))
