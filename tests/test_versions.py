"""Versioned tables, the ledger of files read, and the job that merges into them."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from trafficscore.operators.rfm import rfm_raw_packets
from trafficscore.operators.score import score_rfm
from trafficscore.plans import jobs
from trafficscore.schemas import SCORES_SCHEMA
from trafficscore.sources.ledger import list_files, unread_files
from trafficscore.sources.versions import VersionedTable

UTC = dt.timezone.utc


def _table(spark, rows):
    return spark.createDataFrame(rows, "k string, n long, t long")


def _read(table, version=None):
    df = table.read(version)
    return {} if df is None else {r.k: (r.n, r.t) for r in df.collect()}


def test_upsert_replaces_or_combines_and_keeps_versions(spark, scratch):
    t = VersionedTable(spark, os.path.join(scratch, "t"), "k", n_buckets=8)
    assert t.version() == -1 and t.read() is None and t.tag() is None
    rows = [(f"c{i}", i, i) for i in range(100)] + [(None, 5, 5)]
    assert t.upsert(_table(spark, rows), tag="first") == 0
    assert t.upsert(_table(spark, [("c1", 100, 0), ("new", 1, 1), (None, 6, 6)])) == 1
    assert t.upsert(_table(spark, [("c1", 5, -5), ("c2", 1, 9)]), combine={"n": "sum", "t": "max"}) == 2
    want = {k: (n, x) for k, n, x in rows}
    assert _read(t, 0) == want
    want.update({"c1": (100, 0), "new": (1, 1), None: (6, 6)})
    assert _read(t, 1) == want
    want.update({"c1": (105, 0), "c2": (3, 9)})
    assert _read(t) == want and t.version() == 2
    # an empty change makes a version that writes no bucket
    assert t.upsert(_table(spark, []), tag="none") == 3 and _read(t) == want and t.tag() == "none"


def test_only_touched_buckets_are_written(spark, scratch):
    path = os.path.join(scratch, "t")
    t = VersionedTable(spark, path, "k", n_buckets=32)
    t.upsert(_table(spark, [(f"c{i}", i, i) for i in range(500)]))
    t.upsert(_table(spark, [("c7", 0, 0)]))
    written = [len([d for d in os.listdir(f"{path}/data/v={v}") if d.startswith("bucket_no")]) for v in (0, 1)]
    assert written == [32, 1]


def test_a_run_that_dies_leaves_the_old_version(spark, scratch):
    """Rows and notes are written, the manifest is not: readers see the version before, the next run goes on."""
    t = VersionedTable(spark, os.path.join(scratch, "t"), "k", n_buckets=4)
    note = spark.createDataFrame([("a.csv",)], "path string")
    t.upsert(_table(spark, [("a", 1, 1)]), notes={"files": note})
    bad = note.select(F.raise_error(F.lit("lost")).cast("string").alias("path"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(_table(spark, [("a", 2, 2), ("b", 1, 1)]), notes={"more": note, "files": bad})
    assert os.path.exists(os.path.join(scratch, "t/data/v=1")) and os.path.exists(os.path.join(scratch, "t/notes/more/v=1"))
    assert _read(t) == {"a": (1, 1)} and t.version() == 0
    assert [r.path for r in t.notes("files").collect()] == ["a.csv"] and t.notes("more").collect() == []
    assert t.upsert(_table(spark, [("c", 3, 3)]), notes={"files": note}) == 1
    assert _read(t) == {"a": (1, 1), "c": (3, 3)}
    assert sorted((r.path, r.v) for r in t.notes("files").collect()) == [("a.csv", 0), ("a.csv", 1)]


def _land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("timestamp,src_ip,pkt_len\n" + "".join(f"{t},{ip},{n}\n" for t, ip, n in rows))


def test_ledger_takes_each_file_once(spark, scratch):
    folder = os.path.join(scratch, "logs")
    t = VersionedTable(spark, os.path.join(scratch, "t"), "k", n_buckets=2)
    _land(folder, "a.csv", [("2024-01-01 00:00:00", "1.1.1.1", 5)])
    first = unread_files(t, folder)
    assert [os.path.basename(r.path) for r in first.collect()] == ["a.csv"]
    t.upsert(_table(spark, []), notes={"files": list_files(spark, folder)})
    assert unread_files(t, folder).collect() == []
    _land(folder, "b.csv", [("2024-01-01 00:00:00", "1.1.1.1", 5)])
    assert [os.path.basename(r.path) for r in unread_files(t, folder).collect()] == ["b.csv"]
    # a file changed just now isn't settled; one that changed after it was read is an error
    assert unread_files(t, folder, settle_seconds=3600).collect() == []
    time.sleep(1.1)
    _land(folder, "a.csv", [("2024-01-01 00:00:00", "1.1.1.1", 5), ("2024-01-02 00:00:00", "1.1.1.1", 5)])
    with pytest.raises(ValueError, match="a.csv"):
        unread_files(t, folder)


def test_merged_runs_equal_one_full_run(spark, scratch):
    """Three runs, late rows and a client seen in all of them: the scores of a single run over everything."""
    folder, out, state = (os.path.join(scratch, x) for x in ("logs", "out", "state"))
    parts = [[("2024-01-01 10:00:00", f"10.0.0.{i}", 40 + i) for i in range(20)],
             [("2024-01-01 09:00:00", "10.0.0.3", 500), ("2024-01-02 10:00:00", "10.0.0.99", 60)] * 3,
             [("2024-01-03 10:00:00", f"10.0.0.{i}", 1500) for i in range(0, 20, 3)]]
    runs = [dt.datetime(2024, 1, 1 + k, 12, tzinfo=UTC) for k in range(4)]
    for k, rows in enumerate(parts):
        _land(folder, f"part{k}.csv", rows)
        path = jobs.run_merged(spark, folder, out, state, now=runs[k])
    assert jobs.run_merged(spark, folder, out, state, now=runs[3]) is None

    def scores(df):
        return sorted((r.src_ip, r.r_score, r.f_score, r.m_score, r.composite_score) for r in df.collect())

    every = spark.createDataFrame([r for p in parts for r in p], "t string, src_ip string, pkt_len long").select(
        F.col("t").cast("timestamp").alias("timestamp"), "src_ip", "pkt_len")
    want = scores(score_rfm(rfm_raw_packets(every, runs[2]), "x"))
    got = scores(spark.read.option("header", "true").schema(SCORES_SCHEMA).csv(path))
    assert got == want

    # the snapshot is lost (the run died after its commit): the next run makes up for it, for that run's time
    table = VersionedTable(spark, state, "src_ip")
    other = os.path.join(scratch, "out2")
    again = jobs.run_merged(spark, folder, other, state, now=runs[3])
    assert os.path.basename(again) == os.path.basename(path) and table.version() == 2
    assert scores(spark.read.option("header", "true").schema(SCORES_SCHEMA).csv(again)) == want


def test_a_replayed_batch_is_left_out(spark, scratch):
    from trafficscore.streaming.rfm import read_rfm_versions
    t = VersionedTable(spark, os.path.join(scratch, "t"), "client_ip", n_buckets=2)
    assert read_rfm_versions(t) is None
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 3, 7)], "client_ip string, last_seen timestamp, frequency long, monetary long")
    t.upsert(rows, tag="0")
    assert t.tag() == "0"
    assert [tuple(r) for r in read_rfm_versions(t, "2024-01-03 00:00:00").collect()] == [("a", 2.0, 3, 7)]
