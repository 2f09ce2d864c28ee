import zoneinfo
from datetime import datetime, timezone

import brute
import numpy as np
import pytest
from fixtures import DDL_LOG, SOURCES, change, dicts, log
from pyspark.sql import functions as F

from changeweave.functions.zones import zone_table
from changeweave.operators.instants import instant_micros, normalised_instants, parser_of

SHAPES = [
    ("2024-03-20T15:04:05Z", "2024-03-20T15:04:05"), ("2024-03-20t15:04:05.123456789z", "2024-03-20T15:04:05.123456"), ("2024-03-20 15:04:05.5+02", "2024-03-20T13:04:05.5"),
    ("2024-03-20 15:04:05 +05:30", "2024-03-20T09:34:05"), ("2024-03-20 15:04:05.25 -0400 EDT", "2024-03-20T19:04:05.25"), ("2024-03-20T15:04:05+01:00[Europe/Berlin]", "2024-03-20T14:04:05"),
    ("20240320T150405Z", "2024-03-20T15:04:05"), ("Wed, 20 Mar 2024 15:04:05 GMT", "2024-03-20T15:04:05"), ("1710947045", "2024-03-20T15:04:05"), ("1710947045123", "2024-03-20T15:04:05.123"),
    ("1710947045123456", "2024-03-20T15:04:05.123456"), ("1710947045123456789", "2024-03-20T15:04:05.123456"), (" 2024-03-20 15:04:05,250 ", "2024-03-20T14:04:05.25"),
    ("2024-03-20", "2024-03-19T23:00:00"), ("20/3/2024 3:04:05 PM", "2024-03-20T14:04:05"), ("2024-07-01 12:00:00 CEST", "2024-07-01T10:00:00"), ("2024-07-01 12:00:00 CET", "2024-07-01T11:00:00"),
    ("2024-03-31 02:30:00", "2024-03-31T01:30:00"), ("2024-10-27 02:30:00", "2024-10-27T00:30:00"),
]
NONE = ["", "  ", "infinity", "-infinity", "0000-00-00 00:00:00", "0001-01-01T00:00:00Z", "2024-02-30", "2024-13-01", "not-a-date", "<nil>", "2024-06-11T25:61:00Z", "99999999999", "2024-03-20 12:00:00 XYZ", "9999999999999999999", "13:00", "漢字"]


@pytest.fixture(scope="module")
def berlin(spark):
    rows = [(i, t) for i, t in enumerate([s for s, _ in SHAPES] + NONE + [None])]
    df = spark.createDataFrame(rows, "i int, t string")
    return {r.t: r.m for r in df.withColumn("m", instant_micros(F.col("t"), F.lit(0), F.lit(True), ["Europe/Berlin"])).collect()}


@pytest.mark.parametrize("text, wanted", SHAPES)
def test_shapes(berlin, text, wanted):
    at = datetime.fromisoformat(wanted).replace(tzinfo=timezone.utc)
    assert berlin[text] == int(at.timestamp()) * 10**6 + at.microsecond


@pytest.mark.parametrize("text", [*NONE, None])
def test_no_instant(berlin, text):
    assert berlin[text] is None


def test_shapes_are_looked_up_once():
    parser_of.cache_clear()
    for _ in range(5):
        parser_of("9999-99-99")
    assert parser_of.cache_info().misses == 1


def test_zone_tables_name_their_version():
    assert zone_table("Europe/Berlin").version == zone_table("UTC").version


def test_unknown_stream_null_names_and_empty_logs(spark):
    rows = [change(1, "0/1", "insert", {"a": 1})]
    bare = log(spark, rows).withColumn("column_values", F.array(F.struct(*[F.lit(None).cast(k).alias(n) for n, k in (("string_value", "string"), ("int_value", "bigint"), ("float_value", "double"), ("bool_value", "boolean"))], F.lit("2024-01-01T00:00:00Z").alias("timestamp_value")))).withColumn("column_names", F.array().cast("array<string>"))
    ddl, sources = spark.createDataFrame([], DDL_LOG), spark.createDataFrame([], SOURCES)
    assert [tuple(r) for r in normalised_instants(bare, ddl, sources).collect()] == [("change_log", 1, None, 1704067200000000)]
    assert normalised_instants(bare.limit(0), ddl, sources).count() == 0


def test_large_stream_tables_are_joined(spark, monkeypatch):
    from changeweave.operators import instants

    folder = "/root/testdata/sf0.001"
    args = [spark.read.parquet(f"{folder}/{n}.parquet") for n in ("change_log", "ddl_log", "stream_sources")]
    small = normalised_instants(*args)
    monkeypatch.setattr(instants, "MAX_SOURCES", 3)
    assert normalised_instants(*args).exceptAll(small).count() == 0 and small.exceptAll(normalised_instants(*args)).count() == 0


def test_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    log_, ddl, sources = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("change_log", "ddl_log", "stream_sources"))
    zones = {r["stream_id"]: r for r in dicts(sources)}
    wanted = []
    for r in dicts(log_):
        for i, v in enumerate(r["column_values"] or []):
            z = zones[r["stream_id"]]
            if v and v["timestamp_value"] is not None and (u := brute.instant(v["timestamp_value"], z["server_zone"], z["date_order"] == "dmy")) is not None:
                wanted.append(("change_log", r["delivery_id"], r["column_names"][i] if i < len(r["column_names"]) else None, u))
    for r in dicts(ddl):
        z = zones[r["stream_id"]]
        if (u := brute.instant(r["ddl_time"], z["server_zone"], z["date_order"] == "dmy")) is not None:
            wanted.append(("ddl_log", r["log_id"], "ddl_time", u))
    got = [tuple(r) for r in normalised_instants(log_, ddl, sources).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_offsets_of_all_years():
    """Against the database's own offsets, through the years that text can name."""
    for name in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Africa/Casablanca", "UTC"):
        zone = zoneinfo.ZoneInfo(name)
        times = [datetime(year, month, 15, 12) for year in (2, 1500, 1850, 1899, 1950, 2024, 2099, 2101, 2499, 2500, 2501, 2899, 2900, 3000, 6400, 9999) for month in (1, 4, 7, 12)]
        times += [datetime(9999, 12, 31, 23), datetime(2499, 12, 31, 23), datetime(2499, 12, 30, 23), datetime(2500, 1, 1)]
        wall = np.array([int((t - datetime(1970, 1, 1)).total_seconds()) for t in times])
        wanted = [int(t.replace(tzinfo=zone).utcoffset().total_seconds()) for t in times]
        assert zone_table(name).offset_at_wall(wall).tolist() == wanted, name
