import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from tidemill.functions.zones import transition_rows, zone_table
from tidemill.operators.timestamps import mask_of, normalise_timestamps, parse

ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "UTC", "Europe/London"]


def ms(text, zone="UTC", order="YMD"):
    v, ok = parse(pd.Series([text]), pd.Series([zone]), pd.Series([order]))
    return int(v[0]) if ok[0] else None


def at(*a, zone="UTC", fold=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp() * 1000)


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2021-01-05T03:27:36", "Asia/Tokyo", "YMD", at(2021, 1, 5, 3, 27, 36, zone="Asia/Tokyo")),
        ("6 Jan 2021 07:24", "America/Chicago", "MDY", at(2021, 1, 6, 7, 24, zone="America/Chicago")),
        ("1/26/2021 8:17 AM", "America/New_York", "MDY", at(2021, 1, 26, 8, 17, zone="America/New_York")),
        ("1/26/2021 12:17 AM", "UTC", "MDY", at(2021, 1, 26, 0, 17)),
        ("1/26/2021 12:17 PM", "UTC", "MDY", at(2021, 1, 26, 12, 17)),
        ("27/01/2021 14:51:26", "Australia/Sydney", "DMY", at(2021, 1, 27, 14, 51, 26, zone="Australia/Sydney")),
        ("02.01.21 04:51", "Europe/Berlin", "DMY", at(2021, 1, 2, 4, 51, zone="Europe/Berlin")),
        ("01/02/21 00:31", "UTC", "MDY", at(2021, 1, 2, 0, 31)),
        ("2021年3月2日 21:20:28", "Asia/Tokyo", "YMD", at(2021, 3, 2, 21, 20, 28, zone="Asia/Tokyo")),
        ("2021-01-26", "Europe/Paris", "DMY", at(2021, 1, 26, zone="Europe/Paris")),
        ("1609652572", "Asia/Tokyo", "YMD", 1609652572000),
        ("1609652572383", "Asia/Tokyo", "YMD", 1609652572383),
        ("1609652572383999", "Asia/Tokyo", "YMD", 1609652572383),
        ("2021-01-08 02:42:16,820", "UTC", "YMD", at(2021, 1, 8, 2, 42, 16) + 820),
        ("2021-01-04T20:01:49.385990626+0100", "UTC", "YMD", at(2021, 1, 4, 19, 1, 49) + 385),
        ("2021-09-03T04:00:08+05:30[Asia/Kolkata]", "UTC", "YMD", at(2021, 9, 2, 22, 30, 8)),
        ("20210514T235357-0400", "UTC", "YMD", at(2021, 5, 15, 3, 53, 57)),
        ("Sat, 02 Jan 2021 03:58:30 +1100", "UTC", "DMY", at(2021, 1, 1, 16, 58, 30)),
        ("February 22, 2021 5:18:16 AM UTC", "America/New_York", "MDY", at(2021, 2, 22, 5, 18, 16)),
        ("November 7, 2021 1:30:00 AM EST", "America/New_York", "MDY", at(2021, 11, 7, 6, 30)),
        ("November 7, 2021 1:30:00 AM EDT", "America/New_York", "MDY", at(2021, 11, 7, 5, 30)),
        ("2021-11-07 01:30:00", "America/New_York", "MDY", at(2021, 11, 7, 5, 30)),
        ("2021-03-14 02:30:00", "America/New_York", "MDY", at(2021, 3, 14, 7, 30)),
        ("  2021-01-26 ", "UTC", "YMD", at(2021, 1, 26)),
    ],
)
def test_notations(text, zone, order, want):
    assert ms(text, zone, order) == want


@pytest.mark.parametrize("text", ["", " ", None, "unknown", "yesterday", "null", "-", "n/a", "0000-00-00 00:00:00", "2023-13-45", "2021-02-29", "2021-01-01 24:01", "2021-01-01 10:60", "13:00 PM", "Foo 3, 2021", "7" * 60, "9" * 100_000, "January 1, 2021 1:00:00 AM XYZ"])
def test_no_time(text):
    assert ms(text) is None


@pytest.mark.parametrize("zone", ZONES)
def test_local_times_like_zoneinfo(zone):
    z = ZoneInfo(zone)
    t = zone_table(zone)
    start = datetime(2020, 1, 1)
    locals_ = [start + timedelta(minutes=37 * i) for i in range(40_000)]
    sec = pd.Series([int((x - datetime(1970, 1, 1)).total_seconds()) for x in locals_]).to_numpy()
    want = [int(x.replace(tzinfo=z).timestamp()) for x in locals_]
    assert t.to_utc(sec).tolist() == want


def test_masks_are_shapes():
    assert mask_of("2021-01-05T03:27Z") == "9999-99-99a99:99a"


def test_table_with_nulls_ties_and_unknown_sources(spark):
    rows = [(1, "2021-01-05 10:00", "a"), (1, "2021-01-05 10:00", "a"), (2, None, "a"), (3, "2021-01-05 10:00", None), (4, "2021-01-05T10:00:00Z", "zz"), (5, "2021-01-05 10:00", "bad")]
    df = spark.createDataFrame(rows, "ingest_seq long, timestamp string, source string")
    feeds = spark.createDataFrame([("a", "Asia/Kolkata", "DMY"), ("bad", "No/Zone", "DMY")], "source string, time_zone string, date_order string")
    got = sorted((r["ingest_seq"], r["epoch_ms"]) for r in normalise_timestamps(df, feeds).collect() if r["epoch_ms"] is not None)
    assert got == [(1, at(2021, 1, 5, 4, 30)), (1, at(2021, 1, 5, 4, 30)), (4, at(2021, 1, 5, 10))]
    assert normalise_timestamps(df, feeds).count() == 6
    assert normalise_timestamps(df.limit(0), feeds).count() == 0
    assert normalise_timestamps(df, feeds.limit(0)).where("epoch_ms is not null").count() == 1


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "2021-01-05T10:00:00Z", "a", 7)], "ingest_seq long, timestamp string, source string, epoch_ms int")
    feeds = spark.createDataFrame([("a", "UTC", "YMD")], "source string, time_zone string, date_order string")
    with pytest.raises(ValueError, match="epoch_ms"):
        normalise_timestamps(df, feeds)
    r = normalise_timestamps(df, feeds, prefix="t_").first()
    assert r["epoch_ms"] == 7 and r["t_epoch_ms"] == int(datetime(2021, 1, 5, 10, tzinfo=UTC).timestamp() * 1000)


def test_transition_rows_have_a_version():
    rows = transition_rows(["Europe/Berlin", "No/Zone"])
    assert {r[0] for r in rows} == {"Europe/Berlin"} and {r[4] for r in rows} >= {"CET", "CEST"} and all(r[1] for r in rows)


def test_zones_have_rules_in_any_year():
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    epoch = datetime(1970, 1, 1)
    r = random.Random(3)
    for name in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Tokyo", "America/Sao_Paulo", "Europe/London", "America/Santiago"):
        zone, t = ZoneInfo(name), zone_table(name)
        for _ in range(300):
            d = datetime(r.choice([r.randrange(1810, 2100), r.randrange(2100, 9998)]), r.randrange(1, 13), r.randrange(1, 29), r.randrange(24), r.randrange(60), r.randrange(60))
            own = d.replace(tzinfo=zone)
            if own.utcoffset() != own.replace(fold=1).utcoffset():
                continue  # a gap or overlap
            want = (d - own.utcoffset() - epoch) // timedelta(seconds=1)
            assert int(t.to_utc(np.array([(d - epoch) // timedelta(seconds=1)]))[0]) == want, (name, d)


def test_long_strings_are_read_too():
    s = pd.Series(["1700000000." + "5" * 300, "x" * 100_000, " " * 500 + "2024-01-01"])
    v, ok = parse(s, pd.Series(["UTC"] * 3), pd.Series(["YMD"] * 3))
    assert ok.tolist() == [True, False, True] and v[0] == 1_700_000_000_555 and v[2] == 1704067200000


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidemill.session import shared_dir

    fake = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(fake("yarn", "hdfs:///x/")) == "hdfs:///x"
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(fake(master, None))
