"""Pages to blocks, excluded pages, chunks and code rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import blocks_of, code_facts, syntax_checks
from ..functions.html import NODE, page_nodes

#: Bytes of pages whose nodes a worker holds at once (a longer page is held alone).
PAGE_BYTES = 1 << 20
MIN_PAGE_CHARS, NAV_PAGE_MAX_CHARS, NAV_LINK_RATIO = 300, 800, 0.1
# Titles of pages before and after a book's matter, and numbering in front of titles.
FRONT_BACK_MATTER = "(?i)^(?:머리말|서문|들어가며|들어가는 ?글|저자 ?소개|지은이 ?소개|마치며|맺음말|나가며|감사의 ?글|참고 ?문헌|책 ?구입|구입 ?안내|(?:주요 ?)?변경 ?이력|정답|해답|연습 ?문제)|^(?:preface|acknowledgements?|references|bibliography|exercises?|answers?|solutions?)$"
TITLE_NUMBERING = "^\\s*(?:제?\\s*\\d+\\s*장|\\d+(?:[-.]\\d+)*[.)]?)\\s*"


def page_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (id, page) in slices of about PAGE_BYTES: nodes take many times the room of their page."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PAGE_BYTES)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def parsed_pages(pages: DataFrame, selector: str = "div.page-content", tree_mode: str = "htmlparser", id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, status, chars, link_chars, blocks) for each page, without a shuffle.

    selector: the element that holds a page's body; a page without one (a null page among them) has status "no body" and no
    blocks. tree_mode "htmlparser" nests unclosed paragraphs, "html5" closes them at the next block. Python follows the tags
    and reads Python code; the rest are Column expressions on the nodes.
    """
    names = ["page_id", "status", "chars", "link_chars", "nodes"]
    schema = f"page_id long, status string, chars long, link_chars long, nodes array<{NODE}>"
    text, strings = pa.string(), pa.list_(pa.string())
    line = pa.struct([("depth", pa.int32()), ("mark", text), ("text", text), ("lang", text), ("code", text)])
    node = pa.struct([("op", text), ("tag", text), ("text", text), ("bold", pa.bool_()), ("anchor", text), ("lang", text), ("th", pa.bool_()), ("cells", pa.list_(strings)), ("lines", pa.list_(line))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in page_slices(batch)):
            found = [page_nodes(h, selector, tree_mode == "html5") for h in b.column(1).to_pylist()]
            columns = [pa.array([f[n] for f in found], t) for n, t in zip(names[1:], (text, pa.int64(), pa.int64(), pa.list_(node)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    nodes = pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(run, schema)
    told = nodes.withColumn("facts", F.transform("nodes", lambda n: F.when(n["tag"] == "pre", code_facts(n["lang"], n["text"]))))
    checked = told.withColumn("syntax", syntax_checks(F.transform("facts", lambda f: f["check"])))
    return checked.select("page_id", "status", "chars", "link_chars", blocks_of(F.col("nodes"), F.col("facts"), F.col("syntax")).alias("blocks"))


def block_rows(parsed: DataFrame) -> DataFrame:
    """(page_id, pos, the block's fields), a row for each block."""
    return parsed.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.*")


def exclusion_reason(page_id: Column, title: Column, chars: Column, link_chars: Column, include_ids: Sequence[int] = (), exclude_ids: Sequence[int] = (), exclude_titles: Sequence[str] = ()) -> Column:
    """Why a page holds nothing to ask about; null if it stays. The first rule that applies decides."""
    ratio = link_chars / F.greatest(chars, F.lit(1))
    title = F.coalesce(title, F.lit(""))
    reason = F.when(page_id.isin(list(include_ids)), F.lit(None).cast("string")).when(page_id.isin(list(exclude_ids)), F.lit("설정 exclude_ids"))
    reason = reason.when(F.regexp_replace(title, TITLE_NUMBERING, "").rlike(FRONT_BACK_MATTER), F.lit("부속 페이지 제목"))
    for pattern in exclude_titles:
        reason = reason.when(title.rlike(pattern), F.lit(f"설정 exclude_titles: {pattern}"))
    reason = reason.when(chars < MIN_PAGE_CHARS, F.concat(F.lit("본문 "), chars, F.lit("자")))
    nav = F.concat(F.lit("목차형 페이지 (본문 "), chars, F.lit("자, 링크 "), F.rint(ratio * 100).cast("int"), F.lit("%)"))
    return reason.when((chars < NAV_PAGE_MAX_CHARS) & (ratio >= NAV_LINK_RATIO), nav)


def refine(pages: DataFrame, parsed: DataFrame, base_url: str = "", **rules: Sequence) -> tuple[DataFrame, DataFrame]:
    """(chunks, excluded) of pages (page_id, title, book_id, book_title, breadcrumb) and their parsed bodies.

    A page with blocks that is not excluded is one chunk, {page}-01. Pages without a body are in neither.
    """
    judged = pages.join(parsed.where("status = 'ok'"), "page_id").withColumn("reason", exclusion_reason(F.col("page_id"), F.col("title"), F.col("chars"), F.col("link_chars"), **rules))
    chunk = F.concat(F.col("page_id").cast("string"), F.lit("-01"))
    kept = judged.where("reason is null and size(blocks) > 0")
    chunks = kept.select(chunk.alias("chunk_id"), "page_id", "book_id", "book_title", F.col("title").alias("page_title"), F.coalesce("breadcrumb", F.array().cast("array<string>")).alias("path"), F.concat(F.lit(f"{base_url}/"), F.col("page_id").cast("string")).alias("source_url"), "blocks")
    return chunks, judged.where("reason is not null").select(F.col("page_id").alias("id"), "title", "reason")


def code_rows(chunks: DataFrame) -> DataFrame:
    """The chunks' code, a row each, with ids {chunk}#b{place}, {chunk}#b{box}.{place} inside boxes."""
    blocks = chunks.select("chunk_id", "page_id", "book_id", F.posexplode("blocks").alias("pos", "b")).where("b.codes is not null")
    codes = blocks.select("chunk_id", "page_id", "book_id", "pos", F.posexplode("b.codes").alias("n", "c"))
    return codes.select(F.concat("chunk_id", F.lit("#b"), "c.path").alias("code_id"), "chunk_id", "page_id", "book_id", "pos", "n", *[f"c.{n}" for n in ("type", "lang", "code", "kind", "syntax_ok", "issue", "marked", "error", "pairs")])
