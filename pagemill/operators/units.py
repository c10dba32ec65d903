"""Evidence paragraphs ("units"): runs of blocks of a page, merged to a readable length.

A page's blocks are an array in its row; the rules that look at neighbours walk once over that array, so a page is
handled within its row, in time that grows with its length, and pages never meet.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.text import let, strip

EXPLAIN = ["paragraph", "note", "key_point", "caption", "concept_box"]
ATTACH = ["code", "code_example", "table"]
MIN_UNIT_CHARS, TARGET_CHARS, MAX_CHARS, TAIL_CHARS = 30, 200, 600, 100
# Marks in the texts.
IMAGE_MARK = "\\[이미지: [^\\]]*\\](?U:\\s*)"
FIGURE_REF = "그림\\s?\\d+(\\.\\d+)*"
FENCED_CODE = "(?s)```[^\\n]*\\n.*?```[ \\t]*\\n?"
_RANGES = ArrayType(StructType().add("s", IntegerType()).add("e", IntegerType()))


def sections(blocks: DataFrame) -> DataFrame:
    """blocks (page_id, pos, type, level, text, anchor) with section and section_anchor, carried forward in the page.

    Headings of level 2 and 3 set both, subheadings only the text; other blocks keep what they find.
    """
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = (F.col("type") == "heading") & F.col("level").isin(2, 3)
    text = F.last(F.when(heads | (F.col("type") == "subheading"), F.col("text")), ignorenulls=True).over(upto)
    anchor = F.last(F.when(heads, F.struct("anchor")), ignorenulls=True).over(upto)
    return blocks.withColumn("section", F.coalesce(text, F.lit(""))).withColumn("section_anchor", anchor["anchor"])


def runs(rows: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """rows with run: the number of the run of equal kinds that a row is in, in the order of a column within by."""
    before = Window.partitionBy(by).orderBy(order)
    fresh = F.coalesce(~F.lag(kind).over(before).eqNullSafe(F.col(kind)) | F.lag(F.lit(1)).over(before).isNull(), F.lit(True)).cast("long")
    return rows.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(before.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


# Each of these walks once over a page's blocks: Python on short arrays (kinds, lengths, names of sections), without texts.


def sections_of(kinds: list[str], levels: list[int | None], texts: list[str | None], anchors: list[str | None]) -> tuple[list[str], list[str | None]]:
    """Of each block its section and section anchor, as in `sections`."""
    section, anchor, found = "", None, ([], [])
    for kind, level, text, own in zip(kinds, levels, texts, anchors, strict=True):
        heads = kind == "heading" and level in (2, 3)
        if heads:
            anchor = own
        if (heads or kind == "subheading") and text is not None:
            section = text
        found[0].append(section)
        found[1].append(anchor)
    return found


def ranges_of(kinds: list[str]) -> list[list[int]]:
    """Ranges of blocks [start, end], in order.

    An explaining block is a range; lists in a row are one. Code and tables go with the range before them; those that
    stand alone go with the range right after, or else with the one before if only subheadings are between, or else are
    ranges of their own.
    """
    found: list[list[int]] = []
    hang, near, before = None, False, ""  # where a run of code and tables that has no range yet begins; whether a range is near
    for i, kind in enumerate([*kinds, None]):
        touches = bool(found) and found[-1][1] == i
        explains = kind == "list" or kind in EXPLAIN
        attaches = kind in ATTACH
        if attaches and hang is not None:
            pass
        elif touches and (attaches or (kind == "list" and before == "list")):
            found[-1][1] = i + 1
            near = True
        elif attaches:
            hang = i
        elif explains:
            found.append([i if hang is None else hang, i + 1])
            hang, near = None, True
        else:
            settled = hang is not None
            if settled and near:
                found[-1][1] = i
            elif settled:
                found.append([hang, i])
            hang, near = None, (settled or near) and kind == "subheading"
        before = kind
    return sorted(found)


def merged_of(found: list[list[int]], lengths: list[int | None], places: list) -> list[list[int]]:
    """Ranges grown to TARGET_CHARS by their neighbours, and short ones joined to the range before, up to MAX_CHARS.

    lengths: of each block's text (0 if blank); places: anything that is equal for blocks of one section. Only ranges
    that touch, of one section, merge. A range's length (its texts with a line end between each two) comes from sums over
    the blocks before its ends, taken once.
    """
    sums = [0, *itertools.accumulate(0 if not x else x + 1 for x in lengths)]
    length = lambda s, e: max(sums[e] - sums[s] - 1, 0)
    for too_short in (lambda a, b: length(*a) < TARGET_CHARS, lambda a, b: length(*b) < TAIL_CHARS):
        out: list[list[int]] = []
        for s, e in found:
            last = out[-1] if out else None
            if last and last[1] == s and places[last[0]] == places[s] and too_short(last, (s, e)) and length(last[0], e) <= MAX_CHARS:
                last[1] = e
            else:
                out.append([s, e])
        found = out
    return found


def _as_ranges(rows: Iterable[list[list[int]] | None]) -> pa.Array:
    return pa.array([None if r is None else [{"s": s, "e": e} for s, e in r] for r in rows], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))


@F.arrow_udf(_RANGES)
def ranges(kinds: pa.Array) -> pa.Array:
    """ranges_of for a column of arrays of kinds."""
    return _as_ranges(None if k is None else ranges_of(k) for k in kinds.to_pylist())


@F.arrow_udf(_RANGES)
def merged(found: pa.Array, lengths: pa.Array, places: pa.Array) -> pa.Array:
    """merged_of for columns of ranges, lengths and places."""
    return _as_ranges(None if f is None else merged_of([[x["s"], x["e"]] for x in f], n, p) for f, n, p in zip(found.to_pylist(), lengths.to_pylist(), places.to_pylist(), strict=True))


#: Pages whose blocks a worker holds as Python values at once.
PAGES_AT_ONCE = 128
LAYOUT = StructType().add("section", ArrayType(StringType())).add("anchor", ArrayType(StringType())).add("ranges", _RANGES)


@F.arrow_udf(LAYOUT)
def layout(kinds: pa.Array, levels: pa.Array, texts: pa.Array, anchors: pa.Array, lengths: pa.Array) -> pa.Array:
    """Of a page's blocks the sections and anchors, and the merged ranges."""
    names, columns = pa.list_(pa.string()), (kinds, levels, texts, anchors, lengths)
    parts = []
    for at in range(0, len(kinds), PAGES_AT_ONCE):
        sections_, anchors_, ranges_ = [], [], []
        for k, level, t, a, n in zip(*(c.slice(at, PAGES_AT_ONCE).to_pylist() for c in columns), strict=True):
            s, own = sections_of(k or [], level or [], t or [], a or [])
            sections_.append(s)
            anchors_.append(own)
            ranges_.append(merged_of(ranges_of(k or []), n or [], list(zip(s, own, strict=True))))
        parts.append(pa.StructArray.from_arrays([pa.array(sections_, names), pa.array(anchors_, names), _as_ranges(ranges_)], names=["section", "anchor", "ranges"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("section", names), ("anchor", names), ("ranges", _as_ranges([]).type)]))


def build_units(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, page_id, book_id, page_title, path, source_url, blocks) -> a row for each unit.

    A unit shorter than MIN_UNIT_CHARS, its code included, is dropped; text is without code and image marks (so it may
    be empty), embed_text has all. Units without a section are named by the page; several of a page are numbered.
    Everything happens in the page's row; nothing is shuffled. Only kinds, lengths and headings go through Python.
    """
    head = ["chunk_id", "page_id", "book_id", "path", "source_url"]
    title = F.coalesce(F.when(F.length("page_title") > 0, F.col("page_title")), F.try_element_at("path", F.lit(-1)), F.lit(""))

    def unit(b: Column, r: Column) -> Column:
        chosen = F.slice(b, r["s"] + 1, r["e"] - r["s"])
        not_blank = lambda c, key: F.array_join(F.filter(F.transform(c, lambda x: x[key]), lambda t: F.length(t) > 0), "\n")
        return let(chosen, lambda c: F.struct(
            r["s"].alias("block_start"), r["e"].alias("block_end"), not_blank(c, "render").alias("raw"), not_blank(c, "embed").alias("embed"),
            F.get(c, F.lit(0))["section"].alias("section"), F.get(c, F.lit(0))["anchor"].alias("anchor"), F.flatten(F.transform(c, lambda x: x["code_paths"])).alias("codes"),
        ))

    def units_of(b: Column, found: Column) -> Column:
        """Units with their text, numbered among those without a section."""
        all_ = F.transform(found, lambda r: let(unit(b, r), lambda u: u.withField("full", strip(F.regexp_replace(u["raw"], IMAGE_MARK, "")))))
        long = F.filter(all_, lambda u: F.length(u["full"]) >= MIN_UNIT_CHARS)
        bare = lambda u: F.length(u["section"]) == 0
        numbered = lambda us, n: F.transform(us, lambda u, i: F.struct(u.alias("u"), n.alias("n"), (i + 1).alias("nth")))
        return let(long, lambda us: let(F.filter(us, bare), lambda few: F.concat(numbered(few, F.size(few)), numbered(F.filter(us, lambda u: ~bare(u)), F.size(few)))))

    none = F.array().cast("array<string>")
    readied = F.transform("blocks", lambda x: F.struct(
        x["type"].alias("type"), strip(F.coalesce(x["render"], F.lit(""))).alias("render"), F.coalesce(x["embed"], F.lit("")).alias("embed"),
        F.coalesce(F.transform(x["codes"], lambda c: c["path"]), none).alias("code_paths"), x["level"].cast("int").alias("level"), x["anchor"].alias("anchor"), F.when(x["type"].isin("heading", "subheading"), x["text"]).alias("head"),
    ))
    of = lambda f: F.transform("b", f)
    pages = chunks.select(*head, title.alias("title"), readied.alias("b"))
    pages = pages.withColumn("l", layout(of(lambda x: x["type"]), of(lambda x: x["level"]), of(lambda x: x["head"]), of(lambda x: x["anchor"]), of(lambda x: F.length(x["render"]))))
    placed = F.transform("b", lambda x, i: F.struct(*[x[c].alias(c) for c in ("type", "render", "embed", "code_paths")], F.get("l.section", i).alias("section"), F.get("l.anchor", i).alias("anchor")))
    units = let(placed, lambda b: units_of(b, F.col("l.ranges")))
    rows = pages.select(*head, "title", F.explode_outer(units).alias("x")).where("x is not null").select(*head, "title", "x.u.*", "x.n", "x.nth")
    text = strip(F.regexp_replace(F.regexp_replace("full", FENCED_CODE, ""), "\\n{3,}", "\n\n"))
    named = F.when((F.length("section") > 0) & (F.col("section") != F.col("title")), F.concat(F.lit("["), "title", F.lit("] "), "section")).otherwise(F.concat(F.lit("["), "title", F.lit("]")))
    rows = rows.withColumn("text", text).withColumn("embed_text", strip(F.concat(named, F.lit("\n"), "embed"))).withColumn("fallback", F.length("section") == 0)
    shown = F.when(~F.col("fallback"), F.col("section")).when(F.col("n") > 1, F.concat("title", F.lit(" - "), "nth")).otherwise(F.col("title"))
    url = F.when(F.length("anchor") > 0, F.concat(F.substring_index("source_url", "#", 1), F.lit("#"), "anchor")).otherwise(F.col("source_url"))
    start = F.col("block_start").cast("string")
    return rows.select(
        F.concat("chunk_id", F.lit("#b"), F.when(F.col("block_start") < 1000, F.lpad(start, 3, "0")).otherwise(start)).alias("unit_id"),
        "chunk_id", "page_id", "book_id", "path", shown.alias("section"), "fallback", url.alias("url"), "text", F.transform("codes", lambda p: F.concat("chunk_id", F.lit("#b"), p)).alias("code_ids"),
        F.contains("full", F.lit("```")).alias("has_code"), F.col("raw").rlike(IMAGE_MARK).alias("has_image"), F.col("text").rlike(FIGURE_REF).alias("figure_ref"),
        "block_start", "block_end", "embed_text", F.sha2("embed_text", 256).alias("embed_hash"),
    )
