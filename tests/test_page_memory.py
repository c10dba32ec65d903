"""Pages go through Python in slices of bounded size, whatever the size of a batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.operators import refine, units


def test_slices_of_pages():
    pages = ["", "x" * 10, None, "y" * (3 << 20), *["z" * 400_000] * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], names=["page_id", "html"])
    parts = list(refine.page_slices(batch))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    sizes = [[len(x or "") for x in p.column(1).to_pylist()] for p in parts]
    assert len(parts) > 4 and all(sum(s[:-1]) <= refine.PAGE_BYTES for s in sizes)
    assert list(refine.page_slices(batch.slice(0, 0)))[0].num_rows == 0


def test_layout_is_the_same_in_slices(spark, monkeypatch):
    html = F.concat(F.lit("<article><h2>A</h2>"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("id") % 5 + 1), lambda k: F.format_string("<p>%s</p>", F.repeat(F.lit("word "), k * 20))), ""), F.lit("</article>"))
    blocks = refine.parsed_pages(spark.range(0, 300, 1, 1).select(F.col("id").alias("page_id"), html.alias("html")), selector="article")
    of = lambda f: F.transform("blocks", f)
    said = blocks.select("page_id", units.layout(of(lambda b: b["type"]), of(lambda b: b["level"]), of(lambda b: b["text"]), of(lambda b: b["anchor"]), of(lambda b: F.length(b["render"]))).alias("l"))
    rows = {r["page_id"]: r["l"] for r in said.collect()}
    assert len(rows) == 300 and all(rows[i] == rows[i % 5] and rows[i]["ranges"] for i in rows)
