"""A table of rows with keys that is changed by copying only what a change touches.

Rows lie in buckets by a hash of their key, each bucket in a folder of its own. A manifest names, for each bucket, the
folder that holds it now, its number of rows and a digest of them. A change reads and rewrites the buckets of the changed
keys, in new folders, and writes a further manifest, in which all other buckets keep their folders. Nothing is overwritten:
earlier manifests can be read as long as they are kept, and a job that dies before its manifest is there has changed
nothing. Of two changes at once one fails, because both would write the same manifest.

A manifest has a row for each bucket; their number is fixed when the table is made.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .scratch import written

BUCKETS = 64
_MANIFEST = "bucket int, folder string, n long, digest string"
_BUCKET = "_bucket"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever file system Spark reads it from."""
    at, system = _file_system(spark, path)
    return system.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    at, system = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(at)) if system.exists(at) else []


def is_table(spark: SparkSession, path: str) -> bool:
    return there(spark, f"{path}/manifests")


class BucketTable:
    """A table at path with rows of a schema, one row a key. buckets counts when the table is made; later it is read."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        now = self.version()
        made = self.manifest(now) if now else []
        self.buckets = made[0]["of"] if made else buckets

    # -- reading

    def versions(self) -> list[int]:
        """Numbers of the manifests, in order. One that was not finished does not count."""
        found = [n for n in names_in(self.spark, f"{self.path}/manifests") if n.startswith("v")]
        return [int(n[1:]) for n in found if there(self.spark, f"{self.path}/manifests/{n}/_SUCCESS")]

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int) -> list[dict]:
        """A row for each bucket that was ever written to: bucket, folder, n, digest, of (the number of buckets)."""
        rows = self.spark.read.schema(f"{_MANIFEST}, of int").json(f"{self.path}/manifests/v{version:010d}")
        return [r.asDict() for r in rows.collect()]

    def _rows(self, entries: Iterable[dict]) -> DataFrame:
        folders = [f"{self.path}/{e['folder']}" for e in entries if e["n"]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest; no rows if there is none yet."""
        version = version or self.version()
        return self._rows(self.manifest(version) if version else [])

    def digest(self, version: int | None = None) -> str:
        """A digest of all rows, whatever their order, from the manifest alone."""
        version = version or self.version()
        return " ".join(f"{e['bucket']}:{e['digest']}" for e in sorted(self.manifest(version), key=lambda e: e["bucket"]) if e["n"]) if version else ""

    # -- changing

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame) -> int | None:
        """Inserts rows, or puts them in place of those of the same key. Returns the new version; None if nothing changed.

        Of several rows of one key the one of the smallest hash over all columns is taken. Rows without a key are an error.
        """
        return self._change(rows, keep=True)

    def replace(self, rows: DataFrame) -> int | None:
        """Makes the table hold exactly these rows. Buckets that stay as they are keep their folders."""
        return self._change(rows, keep=False)

    def _change(self, rows: DataFrame, keep: bool) -> int | None:
        names = self.schema.fieldNames()
        found = written(rows.select(*names).withColumn(_BUCKET, self.bucket_of(F.col(self.key))), "change")
        if not found.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError(f"rows without {self.key}")
        one = found.groupBy(self.key).agg(F.min_by(F.struct(*names, _BUCKET), F.xxhash64(*names)).alias("r")).select("r.*")
        before = self.version() or 0
        old = {e["bucket"]: e for e in (self.manifest(before) if before else [])}
        touched = [r[_BUCKET] for r in found.select(_BUCKET).distinct().collect()] if keep else list(range(self.buckets))  # at most as many as there are buckets
        if keep:
            held = self._rows([old[b] for b in touched if b in old])
            held = held.join(found.select(F.col(self.key).alias("_key")).distinct(), F.col(self.key) == F.col("_key"), "left_anti")
            one = held.withColumn(_BUCKET, self.bucket_of(F.col(self.key))).unionByName(one)
        folder = f"rows/{uuid.uuid4().hex}"
        one.repartition(min(max(len(touched), 1), self.buckets), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        now = dict(old)
        for b in touched:
            now[b] = {"bucket": b, "folder": None, "n": 0, "digest": ""}
        for e in self._digests(f"{self.path}/{folder}"):
            same = old.get(e["bucket"], {}).get("digest") == e["digest"]
            now[e["bucket"]] = old[e["bucket"]] if same else e | {"folder": f"{folder}/{_BUCKET}={e['bucket']}"}
        told = lambda entries: {(e["bucket"], e["n"], e["digest"]) for e in entries.values() if e["n"]}
        if told(now) == told(old) and (before or not told(now)):
            self._delete(folder)
            return None
        entries = [(e["bucket"], e["folder"], e["n"], e["digest"], self.buckets) for e in now.values()]
        self.spark.createDataFrame(entries, f"{_MANIFEST}, of int").coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/v{before + 1:010d}")
        return before + 1

    def _digests(self, folder: str) -> list[dict]:
        """n and digest of each bucket in a folder that was just written."""
        if not any(n.startswith(_BUCKET) for n in names_in(self.spark, folder)):
            return []
        rows = self.spark.read.schema(StructType(list(self.schema.fields)).add(_BUCKET, IntegerType())).parquet(folder)
        h = F.xxhash64(*self.schema.fieldNames())
        made = rows.groupBy(_BUCKET).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
        return [{"bucket": r[_BUCKET], "n": r["n"], "digest": f"{r['n']}-{r['s']}-{r['x']}"} for r in made.collect()]

    def _delete(self, name: str) -> None:
        at, system = _file_system(self.spark, f"{self.path}/{name}")
        system.delete(at, True)

    def forget(self, keep: int = 1) -> int:
        """Deletes all but the newest `keep` manifests, and the folders that only those named; returns how many folders went.

        For a time when no other job reads earlier versions or changes the table.
        """
        versions = self.versions()
        for v in versions[:-keep]:
            self._delete(f"manifests/v{v:010d}")
        named = {e["folder"] for v in versions[-keep:] for e in self.manifest(v) if e["folder"]}
        gone = 0
        for made in names_in(self.spark, f"{self.path}/rows"):
            own = [f"rows/{made}/{b}" for b in names_in(self.spark, f"{self.path}/rows/{made}") if b.startswith(_BUCKET)]
            left = [f for f in own if f in named]
            for f in own if left else [f"rows/{made}"]:
                if f not in named:
                    self._delete(f)
                    gone += 1
        return gone
