"""Session helpers.

Library code never creates a session on its own; jobs receive one.  These
helpers give tests and ``bench.py`` a session configured the way the jobs
expect (UTC session clock, AQE with skew-join splitting, Arrow for the few
pandas stages), and find the reliable checkpoint folder of the cluster.
"""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on.  UTC pins the meaning of naive timestamps
# (log files carry local naive times; the session clock decides the parse).
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app_name: str = "trafficscore",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster the submitter owns the session."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("TS_DRIVER_MEMORY", "16g")))
    for k, v in {**JOB_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Naive log timestamps are read as UTC wall clock (quirk Q13)."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset and the master
    is local (tests, a laptop) a fresh scratch folder is created and
    registered; on a cluster an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared (distributed) folder; "
                               "a machine-local folder does not survive executor loss")
        d = tempfile.mkdtemp(prefix="trafficscore-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``trafficscore`` importable in Python workers (``addPyFile`` of a
    zip of the package, once per application).

    Python stages (``mapInPandas``, ``applyInPandasWithState``) unpickle
    functions of this package on the executors; with ``spark-submit
    --py-files`` or an installed package this is a no-op in effect.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    with _SHIP_LOCK:            # streams call this from their own threads
        if app in _SHIPPED:
            return
        pkg = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="trafficscore-pkg-")) / "trafficscore.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in pkg.rglob("*.py"):
                z.write(f, f.relative_to(pkg.parent).as_posix())
        sc.addPyFile(str(out))
        _SHIPPED.add(app)
