"""Page ingestion as a stream: responses arrive as files; each page is parsed once, and a host that blocks is left alone.

Two states, kept by the stream itself and restored from its checkpoint: of each host the run in which it blocked us, and of
each page whether it is done. Neither the output nor anything else that was written before is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Answers that tell a reader to stay away.
BLOCKING = (403, 429)
OK = 200
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HostGate(StatefulProcessor):
    """Rows of a host in their order (run, seq), until one blocks; what comes later in the same run is not let through.

    A row gets an outcome: page, failed (any other status), or blocked (the row that blocks). A later run tries again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocked = handle.getValueState("blocked_run", "run long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        told = pd.concat([r.astype(object) for r in rows]).sort_values(["run", "seq"], kind="stable")
        at = self.blocked.get()[0] if self.blocked.exists() else None
        kept, outcomes = [], []
        for n, (run, status) in enumerate(zip(told["run"].tolist(), told["status"].tolist(), strict=True)):
            if at is not None and run <= at:
                continue
            if status in BLOCKING:
                at = run
            kept.append(n)
            outcomes.append("page" if status == OK else "blocked" if status in BLOCKING else "failed")
        if at is not None:
            self.blocked.update((at,))
        passed = told.iloc[kept]
        yield passed.assign(outcome=pd.Series(outcomes, index=passed.index, dtype=object))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1))


def gated(responses: DataFrame) -> DataFrame:
    """responses (url, status, run, seq, ...), a stream -> the rows that are let through, with outcome (HostGate)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in responses.schema.fields)
    by_host = responses.withColumn("host", host_of(F.col("url"))).groupBy("host")
    return by_host.transformWithStateInPandas(HostGate(), f"{fields}, host string, outcome string", "Append", "None")


def ingest_stream(pages: DataFrame, out: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], id_col: str = "page_id", failed: str | None = None) -> StreamingQuery:
    """pages: a stream of (id_col, html, ...). Appends the parsed form of pages that were not parsed before to `out`.

    With failed, pages are responses (url, status, run, seq as well): those of a host that blocked are left out as HostGate
    tells, pages whose status is not 200 are not done, and go to `failed` as (id, run, outcome, message), once a run. A page
    that failed is parsed when it arrives again in order. Rows without an id are left out. A batch is written under its
    number, so a batch that is run again after a failure replaces its own rows.
    """
    spark = pages.sparkSession
    rows = pages.where(F.col(id_col).isNotNull())
    if failed is None:
        fresh = rows.dropDuplicates([id_col])
    else:
        is_page = F.col("outcome") == "page"
        told = gated(rows.withColumn("status", F.col("status").cast("int")).withColumn("run", F.coalesce(F.col("run").cast("long"), F.lit(0)))).withColumn("_try", F.when(is_page, -1).otherwise(F.col("run")))
        fresh = told.dropDuplicates([id_col, "_try"]).drop("_try", "host")

    def one(batch: DataFrame, number: int) -> None:
        if failed is None:
            parse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
            return
        batch = batch.persist()  # the stream's states are worked out once
        try:
            parse(batch.where("outcome = 'page'").drop("outcome")).write.mode("overwrite").parquet(f"{out}/batch={number}")
            message = F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown")))
            batch.where("outcome <> 'page'").select(id_col, "run", "outcome", message.alias("message")).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        finally:
            batch.unpersist()

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # keeps states on disk, and is what states of our own need; a query takes it along when it starts
    try:
        return fresh.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
