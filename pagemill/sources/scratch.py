"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own on one machine
    (local mode, as in tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder, which remove_written deletes too."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """written(df, what), and some aggregates over its rows, which the job that writes it works out on its way."""
    seen = Observation()
    rows = written(df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[m.alias(k) for k, m in metrics.items()]), what)
    return rows, {k: v for k, v in seen.get.items() if k != "_rows"}


def n_written(spark: SparkSession) -> int:
    """How many tables `written` and places of scratch_path there are by now; a mark for remove_written."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def remove_written(spark: SparkSession, since: int = 0, keep_last: int = 0) -> int:
    """Delete what `written` and scratch_path made in this application after a mark, save for the last keep_last, once no DataFrame
    on it is needed; how many there were. For one thread at a time."""
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths = known[since : len(known) - keep_last]
    del known[since : len(known) - keep_last]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
