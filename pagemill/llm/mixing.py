"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a flow. Its documents are shuffled by a hash, and a copy of a document finishes, in virtual time, at the
source's words up to and including it divided by the source's target. The stream is all copies in the order of virtual
time (of the middle of a copy: its finish less half of its own time, so that a document is taken if at least half of it
fits), so that at every point of it the sources stand near their weights. The stream is sorted by range, and cut where
its running total reaches the budget, which is the sum of the targets. A source misses its target by half of the document
that lies across the cut, and by its share of what the others miss.

Running totals are taken in two levels (partitions of a sort by range, then rows of a partition), so that a source with a
third of all rows is spread over as many tasks as its size asks for. Only narrow rows (no text) are sorted for the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, unboxed, written

#: A table of sources up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: A plan of up to this many documents is broadcast to their texts (some 50 bytes each).
BROADCAST_ROWS = 500_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), repeat: int = 3) -> DataFrame:
    """sources (source, source_size, source_rows) -> the same with sid, weight and target.

    Sources by code point, null last, get the weights in turn and share the sum of all sizes. A target stops at repeat
    times its source's size and the excess goes to the others by weight until none is above: with the sources in order
    of cap / weight, those before the water level are capped, and the level is the largest of the levels that follow
    if all sources before the n-th are capped.
    """
    everywhere = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    ranked = sources.withColumn("sid", F.row_number().over(in_order))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("sid") - 1) % len(weights))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everywhere)
    levels = ranked.withColumn("level", (total - capped) / left)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everywhere))
    return levels.select("source", "source_size", "source_rows", "sid", "weight", target.alias("target"))


def running_totals(rows: DataFrame, order: list[str], what: str, of: str = "size", by: list[str] | None = None) -> DataFrame:
    """rows with upto: the sum of a column over the rows up to each, in an order (within by, which comes first in it).

    Rows are sorted by range; the sums of whole partitions (a row for each, or for each and by) give a partition its start.
    """
    by = by or []
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), what)
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, "part").agg(F.sum(of).alias("in_part")).withColumn("start", F.coalesce(F.sum("in_part").over(before), F.lit(0))).drop("in_part")
    within = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn("within", F.sum(of).over(within)).join(starts, [*by, "part"]).withColumn("upto", F.col("start") + F.col("within")).drop("start", "within", "part")


def row_key(id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), repeat: int = 3, seed: int = 1) -> DataFrame:
    """One row for each row of docs: (id, row_key, source, size, source_size, target, copies, finish).

    copies: how often the mix takes the document, 0 to repeat; finish: the virtual finish time of its first copy (1 is
    where its source reaches its target; a later copy finishes source_size / target after the one before). The same
    input gives the same plan. Documents without words, of size 0, cost nothing: they are taken with the words before
    them in the stream. Rows equal in id, text and source share one place in the order and may differ only in copies.
    An empty table gives no rows; a null source is a source of its own; a null id is an id like any other.
    """
    key = row_key(id_col, text_col, source_col, seed)
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), key.alias("row_key")), "sizes")
    sources = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), weights, repeat), "sources")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = (F.broadcast(sources) if few else sources).withColumnRenamed("source", "source_b").drop("source_rows", "weight")
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("source_b"))).drop("source_b")
    placed = written(running_totals(rows, ["sid", "row_key", "id"], "placed", by=["sid"]).withColumnRenamed("upto", "end").withColumn("row", F.monotonically_increasing_id()), "rows")

    # the stream of all copies, cut where the running total reaches the budget
    time = lambda words: F.coalesce(words / F.when(F.col("target") > 0, F.col("target")), F.lit(0.0))
    copies = placed.select("row", "row_key", "size", F.col("source_size"), "target", "end", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("copy"))
    stream = copies.select("row", "row_key", "copy", "size", time(F.col("source_size") * F.col("copy") + F.col("end") - F.col("size") / 2).alias("middle"))
    budget = sources.agg(F.sum("source_size").alias("b")).first()["b"] or 0
    cut = running_totals(stream, ["middle", "row_key", "copy", "row"], "stream").where(F.col("upto") - F.col("size") / 2 <= F.lit(budget))
    taken = cut.groupBy("row").agg(F.count("*").cast("int").alias("copies"))
    return placed.join(taken, "row", "left").select("id", "row_key", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"), time(F.col("end")).alias("finish"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), repeat: int = 3, seed: int = 1) -> DataFrame:
    """The mixed stream: rows of docs, each as often as the mix takes it, range-sorted by virtual finish time.

    Columns as in docs, whatever their names. Cases as in mix_plan; rows equal in id, text and source all appear as often
    as the first of them.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, weights, repeat, seed).where("copies > 0")
    step = F.coalesce(F.col("source_size") / F.when(F.col("target") > 0, F.col("target")), F.lit(0.0))
    times = F.transform(F.sequence(F.lit(1), F.col("copies")), lambda e: F.col("finish") + step * (e - 1))
    plan = written(plan.groupBy(F.col("id").alias("plan_id"), F.col("row_key").alias("plan_key")).agg(F.max_by(times, F.col("copies")).alias("times")), "taken")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    keyed = boxed(docs, id=F.col(id_col), key=row_key(id_col, text_col, source_col, seed))
    stream = keyed.join(plan, F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("key") == F.col("plan_key"))).select("row", "key", F.explode("times").alias("finish"))
    return unboxed(stream.repartitionByRange("finish", "key").sortWithinPartitions("finish", "key"), docs.columns)
