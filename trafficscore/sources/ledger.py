"""Which log files have been read: exact incremental input.

A time mark misses rows that are stamped before a run and land after it, or reads
rows twice that are stamped on it.  Here a run takes the files that no earlier run
has taken, whatever their rows' times.  The ledger (path, length, modification time)
is a note of the ``VersionedTable`` that the rows go into, so files and rows are committed by the
same manifest: a run that dies leaves both as they were.

Files must be whole when they are listed: writers rename them into place, or
``settle_seconds`` leaves files alone that were changed so shortly before the run.  A
file that changed after it was read is an error, since its rows can't be told from those already counted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficscore.sources.versions import VersionedTable

LEDGER = "files"


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, modified) of the files under ``path``; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length", F.col("modificationTime").alias("modified")))


def unread_files(table: VersionedTable, path: str | list[str], settle_seconds: float = 0,
                 now: dt.datetime | None = None) -> DataFrame:
    """The files under ``path`` that no whole version of ``table`` has taken."""
    listed = list_files(table.spark, path)
    if settle_seconds:
        at = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
        listed = listed.where(F.col("modified") <= at - F.make_dt_interval(secs=F.lit(float(settle_seconds))))
    taken = table.notes(LEDGER)
    if taken is None:
        return listed
    taken = taken.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    changed = listed.join(taken, "path").where("length <> _length OR modified <> _modified")
    found = changed.select("path").limit(5).collect()
    if found:
        raise ValueError(f"log files changed after they were read: {[r['path'] for r in found]}")
    return listed.join(taken, "path", "left_anti")
