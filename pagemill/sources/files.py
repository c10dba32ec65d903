"""Reading and writing the engine's files: JSON lines, CSV with a byte order mark, cached pages, rules, versions."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bucket_table import names_in
from .scratch import counted

PAGE_SCHEMA = "id long, book_id long, book_title string, parent_id long, depth int, `order` int, title string, breadcrumb array<string>, url string, fetched_at string"


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines). A line that is no JSON is set aside."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    lines = spark.read.text(path)
    bad = lines.where((F.length(F.trim("value")) > 0) & F.try_parse_json("value").isNull())
    return rows.where("_bad is null").drop("_bad"), bad


def pages(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, PAGE_SCHEMA)[0].orderBy(F.coalesce("order", F.lit(-1)), "id")


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, "id long")[0].where("id is not null").distinct()


def without(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Lines of a JSON-lines file but those of some ids; lines without a readable id stay."""
    found = F.get_json_object("value", "$.id").try_cast("long")
    return spark.read.text(path).where(found.isNull() | ~found.isin(ids))


def appended(rows: DataFrame, path: str) -> None:
    """Rows as further JSON lines of a folder."""
    rows.write.mode("append").json(path)


def replaced(spark: SparkSession, path: str, target: str, gone: DataFrame) -> None:
    """The JSON lines of path without those of some ids (id), written to target; the caller then reads there."""
    lines = spark.read.text(path).withColumn("_id", F.get_json_object("value", "$.id").try_cast("long"))
    ids = gone.select(F.col("id").cast("long").alias("_gone")).distinct()
    lines.join(ids, lines["_id"] == ids["_gone"], "left_anti").select("value").write.mode("errorifexists").text(target)


def chunk_index(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Chunks of all books; of a repeated chunk_id the one of the last path stays."""
    rows = spark.read.schema(schema).json(glob).withColumn("_path", F.col("_metadata.file_path"))
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("_path")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "_path")


def cached_pages(spark: SparkSession, root: str) -> DataFrame:
    """(id, html) of {root}/*/raw/{id}.html; of a page in several folders the first path."""
    files = spark.read.option("wholetext", True).text(f"{root}/*/raw/*.html").withColumn("_path", F.col("_metadata.file_path"))
    rows = files.select(F.regexp_extract("_path", "/(\\d+)\\.html$", 1).try_cast("long").alias("id"), F.col("value").alias("html"), "_path")
    return rows.where("id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_path"))).where("_n = 1").drop("_n", "_path")


def book_ids(paths: DataFrame) -> DataFrame:
    """paths (path) -> ids of folders named book{n}."""
    return paths.select(F.regexp_extract("path", "(?:^|/)book(\\d+)(?:/|$)", 1).try_cast("int").alias("book_id")).where("book_id is not null").distinct().orderBy("book_id")


def csv_cases(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header whose first name may have a byte order mark; rows without an id are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip(chr(0xFEFF)) for c in rows.columns])
    return rows.where(F.length(F.trim("id")) > 0)


def rules(spark: SparkSession, path: str, source_dir: str) -> dict[str, list]:
    """exclude_titles, exclude_ids, include_ids of a book; a file that is no JSON is a ValueError."""
    empty: dict[str, list] = {"exclude_titles": [], "exclude_ids": [], "include_ids": []}
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # a configuration file
    try:
        return empty | json.loads(text).get(source_dir, {})
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: {e}") from e


def digest_parts(columns: list[str]) -> dict[str, Column]:
    """Aggregates from which digest_of makes a digest of rows, whatever their order."""
    h = F.xxhash64(*columns)
    return {"n": F.count(F.lit(1)), "s": F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), "x": F.coalesce(F.bit_xor(h), F.lit(0))}


def digest_of(parts: dict) -> str:
    return f"{parts['n']}-{parts['s']}-{parts['x']}"


def digest(df: DataFrame) -> str:
    """A digest of the rows, whatever their order."""
    return digest_of(df.agg(*[v.alias(k) for k, v in digest_parts(df.columns).items()]).first().asDict())


def written_if_changed(df: DataFrame, path: str, now: datetime | None = None) -> bool:
    """Write df as a new version under path, unless the latest version has the same rows. Versions are never overwritten.

    The rows are computed once, into a scratch table, and digested on the way; the digest is kept beside the version, so
    that no version is read again to compare it.
    """
    spark = df.sparkSession
    fresh, parts = counted(df, "version", **digest_parts(df.columns))
    now_has = digest_of(parts)
    digests = f"{path}/_digests"  # names with an underscore are no part of the table
    before = names_in(spark, digests)
    if before and spark.read.text(f"{digests}/{before[-1]}").first()["value"] == now_has:
        return False
    stamp = (now or datetime.now()).strftime("v%Y%m%d_%H%M%S_%f")
    fresh.withColumn("version", F.lit(stamp)).write.mode("append").partitionBy("version").parquet(path)
    spark.createDataFrame([(now_has,)], "value string").coalesce(1).write.text(f"{digests}/{stamp}")
    return True


def all_of(**conditions: object) -> Column:
    """One condition from column = value pairs; None values are left out; none at all is true."""
    found = F.lit(True)
    for name, value in conditions.items():
        if value is not None:
            found = found & (F.col(name) == F.lit(value))
    return found


def write_report(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Rows as CSV that spreadsheets open: a byte order mark, a header, quotes doubled. Every part file has its own header."""
    named = rows.withColumnRenamed(rows.columns[0], chr(0xFEFF) + rows.columns[0])
    if order:
        named = named.orderBy(chr(0xFEFF) + order if order == rows.columns[0] else order)
    named.write.option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_messages(failed: DataFrame, path: str) -> None:
    """failed (id, message) as JSON lines, in place of those of an earlier run."""
    failed.write.mode("overwrite").json(path)


def checked_rules(spark: SparkSession, path: str, source_dir: str) -> dict[str, list]:
    """rules(), with every pattern tried once; a bad one is a ValueError that names it."""
    found = rules(spark, path, source_dir)
    for pattern in found["exclude_titles"]:
        try:
            spark.range(1).select(F.lit("").rlike(pattern)).collect()
        except Exception as e:
            raise ValueError(f"{path}: bad pattern {pattern!r}") from e
    return found
