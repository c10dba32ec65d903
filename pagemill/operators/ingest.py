"""From addresses and tables of contents to page records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.blocks import clean_lines
from ..functions.html import links, page_info
from ..sources.scratch import written

PAGE_PATH, BOOK_PATH = "^/(\\d+)/?$", "^/book/(\\d+)/?$"


def parse_target(value: Column, hosts: Sequence[str] | None = None, page_path: str = PAGE_PATH, book_path: str = BOOK_PATH) -> Column:
    """struct(kind, id, error) of a page number or an address. hosts: those allowed; None: any."""
    v = F.trim(value)
    path, host, scheme = (F.try_parse_url(v, F.lit(p)) for p in ("PATH", "HOST", "PROTOCOL"))
    known = scheme.isin("http", "https") & (F.lit(True) if hosts is None else host.isin(list(hosts)))
    number = v.rlike("^[0-9]+$")
    kind = F.when(number, "page").when(known & path.rlike(page_path), "page").when(known & path.rlike(book_path), "book")
    ident = F.when(number, v).when(path.rlike(page_path), F.regexp_extract(path, page_path, 1)).when(path.rlike(book_path), F.regexp_extract(path, book_path, 1))
    error = F.when(kind.isNull(), F.when(~F.coalesce(known, F.lit(False)), "not an allowed address").otherwise("neither page nor book"))
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), ident.try_cast("long")).alias("id"), error.alias("error"))


#: Zero-width space, non-joiner, joiner, and byte order mark.
ZERO_WIDTH = "[" + "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF))) + "]"


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFC, no-break space to space, no zero-width characters. For titles only."""
    return text.str.normalize("NFC").str.replace(chr(0xA0), " ").str.replace(ZERO_WIDTH, "", regex=True)


def toc_items(books: DataFrame) -> DataFrame:
    """books (book_id, html) -> (book_id, id, parent_id, depth, ord, title), a row for each entry with an id.

    Entries are links of class toc-item with data-page-id, data-parent-id, data-depth; ord counts those without id too.
    """

    def number(x: str | None) -> int | None:
        return int(x) if x and x.strip().lstrip("-").isdigit() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for book, html in zip(b["book_id"], b["html"], strict=True):
                for ord_, (attrs, title) in enumerate(links(html, "a.toc-item")):
                    ids = [number(attrs.get(f"data-{k}")) for k in ("page-id", "parent-id", "depth")]
                    if ids[0] is not None:
                        rows.append((book, ids[0], ids[1], ids[2] or 0, ord_, title))
            yield pd.DataFrame(rows, columns=["book_id", "id", "parent_id", "depth", "ord", "title"])

    return books.mapInPandas(run, "book_id long, id long, parent_id long, depth int, ord int, title string").withColumn("title", clean_lines(normalized("title")))


def infos(pages: DataFrame, id_col: str = "id") -> DataFrame:
    """pages (id, html) -> (id, book_id, book_title, page_title) as the page's own markup tells them; null where it does not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [page_info(h) for h in b["html"]]
            yield pd.DataFrame({"id": b[id_col], "book": [f[0] for f in found], "book_title": [f[1] for f in found], "page_title": [f[2] for f in found]})

    rows = pages.select(id_col, "html").mapInPandas(run, "id long, book string, book_title string, page_title string")
    return rows.select("id", F.trim("book").try_cast("long").alias("book_id"), normalized("book_title").alias("book_title"), normalized("page_title").alias("page_title"))


def breadcrumbs(items: DataFrame) -> DataFrame:
    """items (id, parent_id, title) -> (id, breadcrumb): titles from the root. Stops at no parent, 0, a missing one, or a cycle.

    Pointer doubling: each round joins what is known of an entry's ancestors to what its farthest known ancestor knows, so
    a chain of n levels takes log2(n) rounds of one join, however many entries there are. An entry in a cycle goes up until
    it would meet itself or another entry twice. Ids are distinct. Each round's rows are written, which cuts the lineage.
    """
    own = items.select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent"), "title")
    known = own.select(F.col("id").alias("p")).distinct()
    rows = own.join(known, F.col("parent") == F.col("p"), "left").select("id", F.when(F.col("parent") != 0, F.col("p")).alias("above"), F.array(F.struct("id", "title")).alias("up"))
    while not (rows := written(rows, "breadcrumbs")).where("above is not null").isEmpty():
        top = rows.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("up").alias("more"))
        both = rows.join(top, "above", "left")
        # of the ancestors' ancestors those before the first that is known already
        met = F.array_position(F.transform("more", lambda x: F.exists("up", lambda y: y["id"] == x["id"])), True)
        fresh = F.when(met > 0, F.slice("more", 1, (met - 1).cast("int"))).otherwise(F.col("more"))
        rows = both.select("id", F.when(met > 0, F.lit(None).cast("long")).otherwise(F.col("next")).alias("above"), F.when(F.col("more").isNull(), F.col("up")).otherwise(F.concat("up", fresh)).alias("up"))
    return rows.select("id", F.transform(F.reverse("up"), lambda x: x["title"]).alias("breadcrumb"))


def page_records(items: DataFrame, crumbs: DataFrame, base_url: str, books: DataFrame | None = None) -> DataFrame:
    rows = items.join(crumbs, "id")
    rows = rows if books is None else rows.join(books, "book_id", "left")
    return rows.withColumn("url", F.concat(F.lit(f"{base_url}/"), F.col("id").cast("string")))


def targets(items: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries not done yet, in their order, up to a limit."""
    todo = items.join(done.where("id is not null").select("id").distinct(), "id", "left_anti").orderBy(F.coalesce("ord", F.lit(-1)), "id")
    return todo if limit is None else todo.limit(limit)


def source_dir(book_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("book"), book_id.cast("string")), F.lit("unbound"))


def load_or_fetched(pages: DataFrame, cached: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """pages (id) with html: from the cache, else fetched; without either, an error column says so."""
    found = pages.join(cached.select("id", F.col("html").alias("_c")), "id", "left")
    if fetched is not None:
        found = found.join(fetched.select("id", F.col("html").alias("_f")), "id", "left")
    html = F.coalesce(*[F.col(c) for c in ("_c", "_f") if c in found.columns])
    return found.withColumn("html", html).withColumn("error", F.when(F.col("html").isNull(), "not cached")).drop("_c", "_f")


BLOCKED = [403, 429]


def ingested(todo: DataFrame, fetched: DataFrame, crumbs: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """(records, failed) of a run over todo (id, ord, ...): fetched (id, html, status, error) is what came back, in the order of
    ord.

    A page without html fails with its error; from the first answer that blocks (403, 429) on nothing is taken: that page
    fails, those after it are left for the next run. failed: (id, message), in place of an earlier run's.
    """
    rows = todo.join(fetched.select("id", "html", "status", "error"), "id", "left")
    order = F.struct(F.coalesce("ord", F.lit(-1)).alias("o"), "id")
    stop = rows.where(F.col("status").isin(BLOCKED)).agg(F.min(order).alias("s")).first()["s"]
    if stop is not None:
        rows = rows.where(order <= F.struct(F.lit(stop["o"]).alias("o"), F.lit(stop["id"]).alias("id")))
    bad = F.col("status").isin(BLOCKED) | F.col("html").isNull()
    failed = rows.where(F.coalesce(bad, F.lit(True))).select("id", F.coalesce("error", F.concat(F.lit("status "), F.col("status").cast("string")), F.lit("not cached")).alias("message"))
    good = rows.where(F.coalesce(~bad, F.lit(False))).drop("html", "status", "error")
    return page_records(good, crumbs, base_url), failed


def standalone(pages: DataFrame, base_url: str) -> DataFrame:
    """pages (id, html), each with the table of contents of its book inside -> their records.

    A page that its own table does not list has no book: depth 0, order -1, titled by its heading or else its number.
    """
    info = infos(pages)
    toc = toc_items(pages.select(F.col("id").alias("book_id"), "html")).withColumnRenamed("book_id", "page")
    # breadcrumbs of all pages' tables at once: an entry is known by its page and its own number
    numbered = toc.withColumn("key", F.xxhash64("page", "id")).withColumn("up", F.when(F.col("parent_id") != 0, F.xxhash64("page", "parent_id")))
    crumbs = breadcrumbs(numbered.select(F.col("key").alias("id"), F.col("up").alias("parent_id"), "title"))
    mine = numbered.where(F.col("page") == F.col("id")).dropDuplicates(["page"]).join(crumbs.withColumnRenamed("id", "key"), "key").select("page", "parent_id", "depth", "ord", "title", "breadcrumb")
    rows = info.join(mine, F.col("id") == F.col("page"), "left")
    listed = F.col("page").isNotNull()
    title = F.coalesce("title", F.when(F.length("page_title") > 0, F.col("page_title")), F.col("id").cast("string"))
    return rows.select(
        "id", F.when(listed, F.col("book_id")).alias("book_id"), F.when(listed, F.col("book_title")).alias("book_title"), "parent_id", F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("ord", F.lit(-1)).alias("ord"), title.alias("title"), F.coalesce("breadcrumb", F.array(title)).alias("breadcrumb"), F.concat(F.lit(f"{base_url}/"), F.col("id").cast("string")).alias("url"),
    )


def sorted_targets(values: DataFrame, hosts: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """values (value, n) of page numbers and addresses -> (pages (id, n), books (id, n), errors (value, error)), each id once."""
    found = values.withColumn("t", parse_target(F.col("value"), hosts)).select("value", "n", "t.*")
    first = Window.partitionBy("kind", "id").orderBy("n")
    good = found.where("kind is not null").withColumn("k", F.row_number().over(first)).where("k = 1")
    return good.where("kind = 'page'").select("id", "n"), good.where("kind = 'book'").select("id", "n"), found.where("kind is null").select("value", "error")
