"""High-water mark of the incremental scoring job.

One small ISO-8601 text value (the wall-clock time of the last successful
run) on the same shared storage as the logs.  Every save writes a new version folder
(``version=<n>``) and leaves the earlier ones, so a crash while writing
loses nothing: the folder without a committed file is not seen.  The newest version is
read.  No folder -> the epoch, so the first run reads everything; a folder
without any mark is an error, never a silent restart.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _newest(spark: SparkSession, path: str):
    """(version, value) of the newest mark, or None if the path doesn't exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    marks = spark.read.schema("value string, version long").text(path).where("length(trim(value)) > 0")
    best = marks.agg(F.max(F.struct("version", F.trim("value").alias("value"))).alias("m")).first()["m"]
    if best is None:
        raise ValueError(f"the high-water mark at {path!r} holds no value")
    return best["version"], best["value"]


def load_high_water_mark(spark: SparkSession, path: str) -> dt.datetime:
    """Last successful run time (UTC, tz-aware); the epoch when there is no mark yet."""
    found = _newest(spark, path)
    if found is None:
        return EPOCH
    ts = dt.datetime.fromisoformat(found[1])
    return ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)


def save_high_water_mark(spark: SparkSession, path: str, ts: dt.datetime) -> None:
    """Add a version of the mark.  Call only after the run's output is committed."""
    found = _newest(spark, path)
    version = 0 if found is None else found[0] + 1
    (spark.createDataFrame([(ts.isoformat(),)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{path.rstrip('/')}/version={version}"))
