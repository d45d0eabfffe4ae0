"""The registered queries' special branches fire on the driver tables, so a
green oracle row means something."""

import os

import pytest
from pyspark.sql import functions as F

from trafficscore.operators import clean
from trafficscore.plans import catalog as C
from trafficscore.plans import views as V
from trafficscore.sources import hwm as H
from trafficscore.sources import logs as S
from conftest import SF01


def test_hygiene_drops_rows(spark):
    slim, kept = C.q_slim_packets(spark, SF01), C.q_clean_packets(spark, SF01)
    assert kept.count() < slim.count()
    for bad in ("no-time",):
        assert slim.where(F.col("timestamp") == bad).count() > 0
    assert slim.where(F.col("pkt_len").startswith("-")).count() > 0
    assert slim.where(F.col("pkt_len") == "n/a").count() > 0
    decimal = slim.where(F.col("pkt_len").contains(".") & ~F.col("pkt_len").startswith("-")
                         & (F.col("timestamp") != "no-time")).select("line_id")
    assert 0 < decimal.count() == decimal.join(kept, "line_id").count()


def test_unknown_and_duplicate_clients(spark):
    out = C.q_lookup_rfm(spark, SF01)
    unknown = out.where("frequency = -1").select("client_ip").distinct().select(V.last_octet().alias("o")).collect()
    assert any(r.o % 11 == 0 for r in unknown) and any(r.o % 7 == 0 and r.o % 11 for r in unknown)
    assert out.where("frequency <> -1").count() > 0


def test_old_rows_stay_in_a_merge(spark):
    out = C.q_merge_scores(spark, SF01)
    assert out.where(F.col("last_updated") == C.HWM).count() > 0 and out.where(F.col("last_updated") != C.HWM).count() > 0


def test_loopback_verified_and_ipv4_branches(spark):
    out = C.q_decide_unverified(spark, SF01)
    assert out.where("client_ip = '127.0.0.1' and decision = 'challenge'").count() > 0
    whole = C.q_decide_requests(spark, SF01).count()
    assert 0 < out.count() < whole
    assert 0 < C.q_ipv4_flow_fields(spark, SF01).count() < C.q_normalize_flow_fields(spark, SF01).count()
    decimals = C.q_conform_access_log(spark, SF01).where("http_body_length <> floor(http_body_length)")
    assert decimals.count() > 0


def test_corrupt_or_foreign_files(spark, scratch):
    table = os.path.join(scratch, "rfm.parquet")
    os.makedirs(table)
    with open(os.path.join(table, "part-0.parquet"), "wb") as f:
        f.write(b"not parquet at all, not even close")
    with pytest.raises(Exception):
        S.read_rfm_table(spark, table, fmt="parquet").count()
    logs = os.path.join(scratch, "logs")
    os.makedirs(logs)
    with open(os.path.join(logs, "a.csv"), "w") as f:
        f.write("colour,size\nred,1\n")
    with pytest.raises(ValueError, match="no such log"):
        S.read_access_log(spark, logs)
    with pytest.raises(FileNotFoundError):
        S.read_access_log(spark, os.path.join(scratch, "absent"))
    for name, text in (("b.csv", "timestamp,client_ip\n2024-01-01T00:00:00,1.1.1.1\n"), ("c.csv.gz", "")):
        path = os.path.join(scratch, "two")
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, name), "wb") as f:
            f.write(text.encode() or b"\x1f\x8bbroken gzip")
    with pytest.raises(Exception):
        S.read_access_log(spark, os.path.join(scratch, "two"))
    kept = S.read_access_log(spark, os.path.join(scratch, "two"), skip_unreadable=True)
    assert kept.columns == ["timestamp", "client_ip"] and kept.count() == 1


def test_local_times_of_a_zone(spark, scratch):
    logs = os.path.join(scratch, "zone")
    os.makedirs(logs)
    with open(os.path.join(logs, "a.csv"), "w") as f:
        f.write("client_ip,when,size\n9.9.9.9,2024-01-01T09:00:00,1.5\n9.9.9.9,2024-01-01T08:00:00,2\n")
    import datetime as dt

    from trafficscore.plans.jobs import refresh_rfm
    from trafficscore.schemas import ColumnRoles
    out = os.path.join(scratch, "zone_out")
    now = dt.datetime(2024, 1, 1, 0, 0, tzinfo=dt.timezone.utc)
    roles = ColumnRoles(ts_col="when", key_col="client_ip", monetary_col="size")
    assert refresh_rfm(spark, logs, out, now=now, roles=roles, source_tz="Asia/Seoul") == 1
    row = S.read_rfm_table(spark, out).first()
    assert (row.recency_days, row.frequency, row.monetary) == (0.0, 2, 3.5)


def test_empty_mark_is_an_error(spark, scratch):
    import datetime as dt
    path = os.path.join(scratch, "mark")
    first = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    H.save_high_water_mark(spark, path, first)
    os.makedirs(os.path.join(path, "version=1", "_temporary"))        # a save that was cut off
    assert H.load_high_water_mark(spark, path) == first
    H.save_high_water_mark(spark, path, first + dt.timedelta(days=1))
    assert H.load_high_water_mark(spark, path) == first + dt.timedelta(days=1)
    empty = os.path.join(scratch, "empty")
    os.makedirs(os.path.join(empty, "version=0"))
    with pytest.raises(Exception):
        H.load_high_water_mark(spark, empty)


def test_rfm_table_is_sorted(spark, scratch):
    from trafficscore.operators.rfm import compute_rfm
    from trafficscore.sources.sinks import write_rfm_table
    out = os.path.join(scratch, "sorted")
    write_rfm_table(compute_rfm(clean.exclude_static(V.access_log(spark, SF01)), V.EVENTS_NOW), out, single_file=True)
    keys = [r.client_ip for r in S.read_rfm_table(spark, out).collect()]
    assert keys == sorted(keys) and len(keys) > 100
