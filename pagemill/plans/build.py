"""The build of a book: pages to chunks to units to vectors, as a slice of stages over versioned tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.providers import MAX_TOKENS, count_tokens
from ..operators import index, refine, units
from ..sources import bucket_table
from ..sources.files import digest, written_if_changed
from ..sources.scratch import counted, written

STAGES = ("refine", "embed")
CODE_KINDS = ("python", "repl", "ipython", "shell", "pseudo", "output", "other")
STORED = "unit_id string, chunk_id string, page_id long, book_id long, source_dir string, path string, section string, embed_model string, embed_hash string, embedding array<float>"


def stage_slice(first: str = STAGES[0], last: str = STAGES[-1]) -> Sequence[str]:
    """The stages from first to last; first after last is an error."""
    a, b = STAGES.index(first), STAGES.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return STAGES[a : b + 1]


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table, or None if there is none."""
    if bucket_table.is_table(spark, path):
        return vector_table(spark, path).read()
    if not bucket_table.names_in(spark, path):
        return None
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).drop("version")


def vector_table(spark: SparkSession, path: str, buckets: int = bucket_table.BUCKETS) -> bucket_table.BucketTable:
    """The stored units and their vectors, of which a change rewrites only the buckets that it touches."""
    return bucket_table.BucketTable(spark, path, STORED, "unit_id", buckets)


def up_to_date(spark: SparkSession, inputs: str, mark: str) -> bool:
    """Whether a stage has run on input rows of this digest: it is in the stage's mark."""
    marks = latest(spark, mark)
    return marks is not None and marks.first()["digest"] == inputs


def marked(spark: SparkSession, inputs: str, mark: str) -> None:
    written_if_changed(spark.createDataFrame([(inputs,)], "digest string"), mark)


def refine_stage(spark: SparkSession, pages: DataFrame, root: str, selector: str, tree_mode: str, base_url: str, force: bool = False, **rules) -> dict:
    """pages (page_id, title, book_id, book_title, breadcrumb, html) -> chunks, code, excluded; each a new version if it changed.

    Pages and rules that were refined before are left alone, unless force. Tells also how many pages had no body, and the
    code blocks by kind.
    """
    inputs = f"{digest(pages)} {selector} {tree_mode} {base_url} {sorted(rules.items())}"
    if not force and up_to_date(spark, inputs, f"{root}/refined"):
        return {"up_to_date": True}
    parsed, seen = counted(refine.parsed_pages(pages, selector, tree_mode), "parsed", no_body=F.count_if(F.col("status") != "ok"))
    chunks, excluded = refine.refine(pages.drop("html"), parsed, base_url, **rules)
    chunks = written(chunks, "chunks")
    code, kinds = counted(refine.code_rows(chunks), "code", **{k: F.count_if(F.col("kind") == k) for k in CODE_KINDS})
    done = {"chunks": written_if_changed(chunks, f"{root}/chunks"), "code": written_if_changed(code, f"{root}/code"), "excluded": written_if_changed(excluded, f"{root}/excluded")}
    done |= {"no_body": seen["no_body"], "code_kinds": {k: n for k, n in kinds.items() if n}}
    marked(spark, inputs, f"{root}/refined")
    return done


def embed_stage(spark: SparkSession, root: str, embed: Callable[[list[str]], list[list[float]]], source_dir: str, model: str, rebuild: bool = False) -> dict[str, int]:
    """Brings the vector table up to the units: counts of new, changed, same and stale rows, and of texts too long for the model.

    Stale rows stay, unless the table is rebuilt; in both cases vectors of the same hash are kept, and a text without one is
    embedded once.
    """
    rows = written(units.build_units(latest(spark, f"{root}/chunks")), "units")
    table = vector_table(spark, f"{root}/vectors")
    stored = table.read()
    status, counts = counted(index.diff(stored, rows), "status", **{k: F.count_if(F.col("status") == k) for k in ("new", "changed", "same", "stale")})
    counts = {k: n for k, n in counts.items() if n}
    todo = rows if rebuild else rows.join(status.where("status in ('new', 'changed')").select("unit_id"), "unit_id", "left_semi")
    if rebuild or counts.get("new") or counts.get("changed"):
        ready = index.metadata(todo, source_dir, model).join(todo.select("unit_id", "embed_text"), "unit_id")
        made = written(index.embedded(ready, stored, embed), "embedded")
        table.replace(made) if rebuild else table.upsert(made)
    return counts | {"too_long": index.too_long(todo, count_tokens, MAX_TOKENS).count()}


def build(spark: SparkSession, pages: DataFrame, root: str, embed: Callable[[list[str]], list[list[float]]], first: str = STAGES[0], last: str = STAGES[-1], selector: str = "div.page-content", tree_mode: str = "htmlparser", base_url: str = "", source_dir: str = "unbound", model: str = "stub", force: bool = False, rebuild: bool = False, **rules) -> dict[str, dict]:
    """Runs a slice of stages in order; an error in one ends the run. Returns what each did, and its seconds."""
    done: dict[str, dict] = {}
    for stage in stage_slice(first, last):
        began = time.time()
        result = refine_stage(spark, pages, root, selector, tree_mode, base_url, force, **rules) if stage == "refine" else embed_stage(spark, root, embed, source_dir, model, rebuild)
        done[stage] = {**result, "seconds": round(time.time() - began, 2)}
    return done
