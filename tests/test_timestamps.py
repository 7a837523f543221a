from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftline.operators import timestamps as T

CASES = [
    ("2024-02-14T10:25:53Z", "en-US", "America/New_York", "2024-02-14T10:25:53.000Z"),
    ("Wed, 31 Jan 2024 07:50:10 GMT", "en-GB", "Europe/London", "2024-01-31T07:50:10.000Z"),
    ("1697590343495", "pl-PL", "Europe/Warsaw", "2023-10-18T00:52:23.495Z"),
    ("1612263568.996", "en-GB", "Europe/London", "2021-02-02T10:59:28.996Z"),
    ("03/10/2024 1:30 AM", "en-US", "America/New_York", "2024-03-10T06:30:00.000Z"),
    ("11/03/2019 1:44 AM", "en-US", "America/New_York", "2019-11-03T05:44:00.000Z"),
    ("11/03/2019 01:44", "en-GB", "Europe/London", "2019-03-11T01:44:00.000Z"),
    ("31 octobre 2021 à 2h40", "fr-FR", "Europe/Paris", "2021-10-31T00:40:00.000Z"),
    ("28 mars 2021 à 2h30", "fr-FR", "Europe/Paris", None),
    ("2022年12月19日 10:10", "ja-JP", "Asia/Tokyo", "2022-12-19T01:10:00.000Z"),
    ("20 мая 2023 г., 15:48", "ru-RU", "Europe/Moscow", "2023-05-20T12:48:00.000Z"),
    ("16 de julio de 2024, 06:24", "es-ES", "Europe/Madrid", "2024-07-16T04:24:00.000Z"),
    ("25 kwietnia 2022, 07:25", "pl-PL", "Europe/Warsaw", "2022-04-25T05:25:00.000Z"),
    ("5. Juli 2022, 20:33 Uhr", "de-DE", "Europe/Berlin", "2022-07-05T18:33:00.000Z"),
    ("2024-05-07 18:09:59 AEST", "en-AU", "Australia/Sydney", "2024-05-07T08:09:59.000Z"),
    ("20221109", "en-AU", "Australia/Sydney", "2022-11-08T13:00:00.000Z"),
    ("23.08.20 09:31", "de-DE", "Europe/Berlin", "2020-08-23T07:31:00.000Z"),
    ("2022-07-07T11:11:59.656180778Z", "en-GB", "Europe/London", "2022-07-07T11:11:59.656Z"),
    ("2023-02-30T10:00:00Z", "en-GB", "Europe/London", None),
    ("2022-13-04 08:15", "en-GB", "Europe/London", None),
    ("yesterday", "en-GB", "Europe/London", None),
    ("", "en-GB", "Europe/London", None),
    (None, None, None, None),
    ("2024-01-01 10:00", "en-GB", None, None),
    ("x" * 50_000, "en-GB", "Europe/London", None),
    ("1945-06-01 12:00", "en-GB", "Europe/London", "1945-06-01T10:00:00.000Z"),
    ("1945-01-10 12:00", "en-GB", "Europe/London", "1945-01-10T11:00:00.000Z"),
    ("1700-06-01 12:00", "en-GB", "Europe/London", "1700-06-01T12:01:15.000Z"),
    ("2150-07-01 12:00", "de-DE", "Europe/Berlin", "2150-07-01T10:00:00.000Z"),
    ("2150-03-29 02:30", "de-DE", "Europe/Berlin", None),
    ("2412-12-31 23:59", "en-AU", "Australia/Sydney", "2412-12-31T12:59:00.000Z"),
]


def test_formats(spark):
    rows = [(i, t, loc, z, "kept", "kept") for i, (t, loc, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i INT, t STRING, loc STRING, z STRING, zone STRING, p STRING")
    zones = [z for _, _, z, _ in CASES if z] + ["no/zone"]
    got = {r["i"]: r for r in T.instants(df, "t", "loc", "z", zones).collect()}
    assert len(got) == len(CASES)
    for i, (t, _, _, want) in enumerate(CASES):
        assert got[i]["instant"] == want, (t, got[i])
        assert got[i]["zone"] == "kept"


def test_skipped_and_repeated_hours_are_told(spark):
    df = spark.createDataFrame([("2021-03-28 02:30", "2021"), ("2021-10-31 02:30", "b"), ("2021-06-01 02:30", "c")], "t STRING, k STRING").selectExpr("*", "'de-DE' AS l", "'Europe/Berlin' AS z")
    assert [r["verdict"] for r in T.instants(df, "t", "l", "z", ["Europe/Berlin"]).orderBy("k").collect()] == ["nonexistent", "ambiguous", "single"]


@given(st.integers(-5_000_000_000, 3_000_000_000), st.sampled_from(["Europe/Berlin", "America/Chicago", "Australia/Sydney", "Asia/Kolkata", "Europe/London", "Africa/Casablanca", "Europe/Dublin", "America/Sao_Paulo", "Asia/Tehran", "Antarctica/Troll"]))
def test_intervals_hold_every_instant(second, zone):
    offset = int(datetime.fromtimestamp(second, timezone.utc).astimezone(ZoneInfo(zone)).utcoffset().total_seconds())
    assert [o for a, b, o, _ in T.offset_intervals(zone) if a <= second < b] == [offset]


def test_empty_tables_and_repeated_rows(spark):
    v = spark.createDataFrame([("d", 1, "2024-01-01 00:00", "http://WWW.a.example:80/x", ("March 3, 2023 1:00 PM",))] * 2, "doc_id STRING, version INT, fetched_at STRING, final_url STRING, meta STRUCT<publishedAt: STRING>")
    s = spark.createDataFrame([("a.example", "en-US", "America/New_York")] * 2, "host STRING, locale STRING, time_zone STRING")
    got = sorted((r["field"], r["instant"]) for r in T.found(v, s).collect())
    assert got == [("fetched_at", "2023-12-31T23:00:00.000Z"), ("published_at", "2023-03-03T18:00:00.000Z")]
    assert T.found(v.limit(0), s).count() == 0
    assert T.found(v, s.limit(0)).count() == 1


def test_dates_without_a_known_month(spark):
    assert T.month_words()["de|märz"] == 3
    with pytest.raises(KeyError):
        T.month_words()["en|ju"]
