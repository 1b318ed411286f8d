from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.timestamps import to_micros, utc_micros
from millrace.functions.zones import zone_tables
from millrace.operators.events import distinct_events

Z = zone_tables()
NOW = 1_700_000_000_123_456


def read(text, tz=None):
    return to_micros(pa.array([text], pa.string()), pa.array([tz], pa.string()), Z)[0].as_py()


def us(*parts):
    d = datetime(*parts, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return d // timedelta(microseconds=1)


@pytest.mark.parametrize(
    ("text", "tz", "want"),
    [
        ("2024-01-02T03:04:05.678901Z", "Asia/Tokyo", us(2024, 1, 2, 3, 4, 5, 678901)),
        ("2024-01-02T03:04:05.678901999Z", None, us(2024, 1, 2, 3, 4, 5, 678901)),
        ("2024-01-02T03:04:05." + "678901" * 400 + "Z", "Asia/Tokyo", us(2024, 1, 2, 3, 4, 5, 678901)),
        ("2024-01-02 03:04:05," + "5" * 200, "Asia/Kolkata", us(2024, 1, 1, 21, 34, 5, 555555)),
        ("2024-01-02T03:04:05+01:00[" + "x" * 150 + "]", None, us(2024, 1, 2, 2, 4, 5)),
        ("2024-01-02 03:04:05", None, us(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02 03:04:05", "Asia/Kolkata", us(2024, 1, 1, 21, 34, 5)),
        ("2024-01-02 03:04:05,5", "UTC", us(2024, 1, 2, 3, 4, 5, 500000)),
        ("01/02/2024 12:04:05 AM", "UTC", us(2024, 1, 2, 0, 4, 5)),
        ("01/02/2024 12:04:05 PM", "UTC", us(2024, 1, 2, 12, 4, 5)),
        ("01.02.2024 03:04", "Europe/Berlin", us(2024, 2, 1, 2, 4)),
        ("2024-07-01", "America/New_York", us(2024, 7, 1, 4)),
        ("20240102T030405Z", None, us(2024, 1, 2, 3, 4, 5)),
        ("Tue, 02 Jan 2024 03:04:05 -0330", None, us(2024, 1, 2, 6, 34, 5)),
        ("2024-01-02 03:04:05 CEST", "Asia/Tokyo", us(2024, 1, 2, 1, 4, 5)),
        ("2024-01-02T03:04:05+01:00[Europe/Berlin]", None, us(2024, 1, 2, 2, 4, 5)),
        ("1700000000", None, 1_700_000_000_000_000),
        ("1700000000123", "Asia/Tokyo", 1_700_000_000_123_000),
        ("1700000000123456", None, NOW),
        # skipped and repeated wall time
        ("2024-03-31 02:30:00", "Europe/Berlin", us(2024, 3, 31, 1, 30)),
        ("2023-10-29 02:30:00", "Europe/Berlin", us(2023, 10, 29, 0, 30)),
        ("2024-11-03 01:30:00", "America/New_York", us(2024, 11, 3, 5, 30)),
        # beyond the listed transitions
        ("2500-07-01 00:00:00", "Europe/Berlin", us(2500, 6, 30, 22)),
    ],
)
def test_notations(text, tz, want):
    assert read(text, tz) == want


@pytest.mark.parametrize(
    "text",
    [None, "", "-", "unknown", "2024-13-01 00:00:00", "31.02.2024 08:15", "2023-02-29", "2024-01-02 24:00:00", "2024-01-02 10:60:00",
     "01/02/2024 13:00:00 PM", "2024-01-02X03:04:05Z", "2024-01-02 03:04:05 XYZ", "0000-00-00 00:00:00", "x" * 5000, "１２３４５６７８９０"],
)
def test_unreadable(text):
    assert read(text, "UTC") is None


def test_long_texts_among_others():
    texts = ["2024-01-02 03:04:05", "x" * 5000, None, "2024-01-02 03:04:05." + "1" * 99, "7" * 300]
    got = to_micros(pa.array(texts, pa.string()), pa.array(["UTC", None, None, "Europe/Berlin", None], pa.string()), Z).to_pylist()
    assert got == [us(2024, 1, 2, 3, 4, 5), None, None, us(2024, 1, 2, 2, 4, 5, 111111), None]


def test_unknown_zone_matters_only_for_wall_time():
    assert read("2024-01-02 03:04:05", "Mars/Olympus") is None
    assert read("2024-01-02T03:04:05Z", "Mars/Olympus") == us(2024, 1, 2, 3, 4, 5)


@settings(max_examples=60, deadline=None)
@given(st.integers(-5_000_000_000, 12_000_000_000), st.sampled_from(["Europe/Lisbon", "Australia/Lord_Howe", "America/St_Johns", "Asia/Yekaterinburg"]))
def test_wall_time_like_zoneinfo(wall, name):
    zone = ZoneInfo(name)
    local = datetime(1970, 1, 1) + timedelta(seconds=wall)
    if not datetime(1971, 1, 1) < local < datetime(2300, 1, 1):
        return
    want = int(local.replace(tzinfo=zone, fold=0).timestamp())
    assert Z.to_utc(np.array([wall]), np.array([Z.zone(name)]))[0] == want


def test_column_trims_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "\t 1700000000 ", None), (2, None, "UTC")], "id int, ts string, tz string")
    assert {r.id: r.u for r in df.select("id", utc_micros("ts", "tz").alias("u")).collect()} == {1: 1_700_000_000_000_000, 2: None}


def test_each_event_once(spark):
    rows = [(1, "1700000000", "a", 5), (1, "2023-11-14T22:13:20Z", "a", 6), (2, "bad", "b", 7), (None, "1700000000", "c", 8), (3, "1700000001", None, 9)]
    df = spark.createDataFrame(rows, "id long, ts string, x string, t long")
    out = distinct_events(df, "id", {"x": "x"}, ts="ts")
    assert sorted(out.collect(), key=lambda r: r.id) == [(1, "a", 1_700_000_000_000_000), (3, None, 1_700_000_001_000_000)]
    assert distinct_events(df.limit(0), "id", {"x": "x"}, ts="ts").count() == 0
