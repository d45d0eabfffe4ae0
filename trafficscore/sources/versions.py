"""A table of one row per key that is changed by copy on write and read as whole versions.

Layout under ``path``::

    data/v=<n>/bucket_no=<b>/    the rows of bucket b as version n wrote them
    notes/<name>/v=<n>/          rows committed together with version n (a ledger of files read, say)
    manifest/v=<n>/              one row per bucket: the version that wrote it last

Rows are dealt to ``n_buckets`` buckets by a hash of the key.  ``upsert`` reads and
writes only the buckets that its changes touch, so what a run writes grows with the changed
keys, not with the table.  The manifest is written last, as one file: it is the
version pointer.  A run that dies before it leaves the old version readable, with its
notes; what it left behind has the next version's number and is overwritten by the next run.
One writer at a time.  A reader holds on to the version it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficscore.plans.strategies import materialize

N_BUCKETS = 64
_MANIFEST = "bucket_no int, data_version long, tag string"


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, n_buckets: int = N_BUCKETS):
        self.spark, self.path, self.key, self.n_buckets = spark, path.rstrip("/"), key, n_buckets

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, int | None], str | None]:
        """(version, bucket -> version that wrote it, tag); version -1 and no buckets where there is none."""
        folder = f"{self.path}/manifest"
        if not path_exists(self.spark, folder):
            return -1, {}, None
        rows = self.spark.read.schema(f"{_MANIFEST}, v long").parquet(folder)
        if version is None:
            version = rows.agg(F.max("v")).first()[0]
        # one row a bucket
        found = rows.where(F.col("v") == F.lit(version)).collect() if version is not None else []
        if not found:
            return -1, {}, None
        return version, {r["bucket_no"]: r["data_version"] for r in found}, found[0]["tag"]

    def version(self) -> int:
        """The newest whole version, -1 where there is none."""
        return self._manifest()[0]

    def tag(self) -> str | None:
        """What the newest version's writer called it."""
        return self._manifest()[2]

    def _rows(self, buckets: dict[int, int | None], only: set[int] | None = None) -> DataFrame | None:
        places = [f"{self.path}/data/v={v}/bucket_no={b}" for b, v in sorted(buckets.items())
                  if v is not None and (only is None or b in only)]
        return self.spark.read.parquet(*places) if places else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version (the newest); None before the first row."""
        return self._rows(self._manifest(version)[1])

    def notes(self, name: str) -> DataFrame | None:
        """The rows of that note of all whole versions, with their version ``v``."""
        newest, folder = self.version(), f"{self.path}/notes/{name}"
        if newest < 0 or not path_exists(self.spark, folder):
            return None
        return self.spark.read.parquet(folder).where(F.col("v") <= newest)

    def upsert(self, changes: DataFrame, combine: dict[str, str] | None = None, tag: str | None = None,
               notes: dict[str, DataFrame] | None = None) -> int:
        """Write a new version with ``changes`` (one row per key), return its number.

        Rows of known keys are replaced, or combined with the old row column by column:
        ``combine`` gives an aggregate (``sum``, ``max``, ``min``) for every column but the key."""
        old, buckets, _ = self._manifest()
        n = len(buckets) or self.n_buckets
        buckets = buckets or dict.fromkeys(range(n))
        version = old + 1
        columns = [c for c in changes.columns if c != self.key]
        changes = materialize(changes.withColumn("bucket_no", F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")))
        touched = {r["bucket_no"] for r in changes.select("bucket_no").distinct().collect()}     # n_buckets at most
        rows = changes.withColumn("_new", F.lit(1))
        before = self._rows(buckets, touched)
        if before is not None:
            bucket = F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int").alias("bucket_no")
            rows = rows.unionByName(before.select(*changes.columns[:-1], bucket, F.lit(0).alias("_new")))
        if combine:
            merged = rows.groupBy("bucket_no", self.key).agg(*[getattr(F, combine[c])(c).alias(c) for c in columns])
        else:
            merged = (rows.groupBy("bucket_no", self.key).agg(F.max_by(F.struct(*columns), "_new").alias("_row"))
                      .select("bucket_no", self.key, "_row.*"))
        if touched:
            merged.repartition(len(touched), "bucket_no").write.mode("overwrite").partitionBy("bucket_no").parquet(
                f"{self.path}/data/v={version}")
        for name, df in (notes or {}).items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/notes/{name}/v={version}")
        manifest = [(b, version if b in touched else v, tag) for b, v in sorted(buckets.items())]
        self.spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/v={version}")
        return version
