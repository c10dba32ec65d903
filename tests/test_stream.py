"""Ingestion as a stream: restarts, repeated pages, and hosts that block."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from pagemill.streaming.ingestion import host_of, ingest_stream

SCHEMA = "page_id long, url string, status int, run long, seq long, html string"


@pytest.fixture
def stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def arrive(*rows):
        """rows (page_id, host, status, run, seq); a restart of the stream from its checkpoint for each call."""
        made = [(i, f"https://{h}/{i}", s, r, q, f"<p>{i}</p>") for i, h, s, r, q in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}")
        pages = spark.readStream.schema(SCHEMA).parquet(f"file://{source}")
        query = ingest_stream(pages, f"file://{tmp_path}/out", f"file://{tmp_path}/check", lambda b: b.select("page_id", F.length("html").alias("n")), failed=f"file://{tmp_path}/failed")
        query.awaitTermination(180)
        assert query.exception() is None
        done = sorted(r["page_id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
        return done, sorted((r["page_id"], r["run"], r["outcome"], r["message"]) for r in spark.read.parquet(f"file://{tmp_path}/failed").collect())

    return arrive


def test_a_host_that_blocks_is_left_alone_for_the_run(stream):
    done, failed = stream((1, "a", 200, 1, 1), (2, "a", 403, 1, 2), (3, "a", 200, 1, 3), (4, "b", 200, 1, 1), (5, "b", 500, 1, 2), (6, "b", 200, 1, 3))
    assert done == [1, 4, 6] and failed == [(2, 1, "blocked", "status 403"), (5, 1, "failed", "status 500")]
    # after a restart the host is still blocked in this run
    done, failed = stream((7, "a", 200, 1, 9), (8, "b", 200, 1, 9))
    assert done == [1, 4, 6, 8] and len(failed) == 2
    # the next run tries again: what failed, and what was not let through
    done, failed = stream((2, "a", 200, 2, 1), (3, "a", 200, 2, 2), (5, "b", 404, 2, 1), (5, "b", 404, 2, 2))
    assert done == [1, 2, 3, 4, 6, 8] and failed[-1] == (5, 2, "failed", "status 404") and len(failed) == 3


def test_a_page_is_parsed_once_across_restarts_without_reading_what_was_written(stream, tmp_path):
    done, _ = stream((1, "a", 200, 1, 1), (1, "a", 200, 1, 2), (1, "b", 200, 1, 1), (None, "a", 200, 1, 3))
    assert done == [1]
    shutil.rmtree(tmp_path / "out")  # the states alone tell what is done
    done, failed = stream((1, "a", 200, 2, 1), (2, "a", 200, 2, 2), (3, "A", 429, 2, 3), (4, "a", 200, 2, 4))
    assert done == [2] and [f[:3] for f in failed] == [(3, 2, "blocked")]


def test_hosts(spark):
    df = spark.createDataFrame([("https://A.b:1/x?y",), ("http://c",), ("no url",), (None,)], "u string")
    assert [r["h"] for r in df.select(host_of(F.col("u")).alias("h")).collect()] == ["a.b:1", "c", "", ""]
