"""Column helpers: tags, time, text."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsdeck.functions.tags import entries_to_map, present_and_not, tag_equals, tag_exists, tag_truthy, truthy
from opsdeck.functions.text import age_label, owner_or_unknown, severity, short_name, to_pounds
from opsdeck.functions.timefns import (add_hours, as_of_lit, calendar_days, created_display, elapsed_days,
                                       expiry_phrase, iso_z, ordinal, parse_iso)


def one(spark, col, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first().r


@pytest.mark.parametrize("value,expected", [(None, False), ("", False), ("0", False), ("00", True), ("x", True)])
def test_truthy(spark, value, expected):
    assert one(spark, truthy(F.col("x")), value=value) is expected


def test_tag_predicates(spark):
    df = spark.createDataFrame([({"role": "test", "e": "", "z": None},), ({},), (None,)], "tags map<string,string>")
    rows = df.select(tag_equals("role", "test").alias("eq"), tag_exists("e").alias("ex"),
                     tag_exists("z").alias("z"), tag_truthy("e").alias("tr")).collect()
    assert [tuple(r) for r in rows] == [(True, True, False, False), (False, False, False, False),
                                        (False, False, False, False)]


def test_present_and_not(spark):
    vals = [None, "", "bot@x", "0", "a@x"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    assert [r.r for r in df.select(present_and_not(F.col("x"), "bot@x").alias("r")).collect()] == \
        [False, False, False, True, True]


def test_entries_to_map_last_wins(spark):
    df = spark.createDataFrame([
        ([("a", "1"), ("b", "2"), ("a", "3")],),
        ([("a", "1"), ("b", "2")],),
        ([(None, "x"), ("a", "1")],),
        ([],),
        (None,),
    ], "Tags array<struct<Key:string,Value:string>>")
    got = [r.m for r in df.select(entries_to_map("Tags").alias("m")).collect()]
    assert got == [{"b": "2", "a": "3"}, {"a": "1", "b": "2"}, {"a": "1"}, {}, {}]


def test_parse_iso_forms(spark):
    for text, expected in [("2001-07-31T12:00:00Z", dt.datetime(2001, 7, 31, 12)),
                           ("2001-07-31T12:00:00.000Z", dt.datetime(2001, 7, 31, 12)),
                           ("2001-07-31T03:47:05Z", dt.datetime(2001, 7, 31, 3, 47, 5)),
                           ("2001-07-31T12:00:00+01:00", dt.datetime(2001, 7, 31, 11)),
                           ("2001-07-31T12:00:00.000+05:30", dt.datetime(2001, 7, 31, 6, 30)),
                           ("2001-07-31T12:00:00-0800", dt.datetime(2001, 7, 31, 20)),
                           ("2001-07-31 00:30:00+01:00", dt.datetime(2001, 7, 30, 23, 30)),
                           ("2001-07-31", dt.datetime(2001, 7, 31)),
                           ("", None), ("garbage", None), (None, None)]:
        assert one(spark, parse_iso(F.col("x")), value=text) == expected


@pytest.mark.parametrize("start,end,elapsed,calendar", [
    ("2001-07-30 13:00:00", "2001-07-31 12:00:00", 0, 1),
    ("2001-07-30 12:00:00", "2001-07-31 12:00:00", 1, 1),
    ("2001-08-01 11:00:00", "2001-07-31 12:00:00", 0, -1),
    ("2001-08-02 13:00:00", "2001-07-31 12:00:00", -2, -2),
    ("2001-06-01 00:00:00", "2001-07-31 12:00:00", 60, 60),
])
def test_day_differences(spark, start, end, elapsed, calendar):
    df = spark.createDataFrame([(start, end)], "a string, b string").select(
        F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    r = df.select(elapsed_days(F.col("a"), F.col("b")).alias("e"), calendar_days(F.col("a"), F.col("b")).alias("c")).first()
    assert (r.e, r.c) == (elapsed, calendar)


def test_session_time_zone_does_not_matter(spark):
    df = spark.createDataFrame([("2001-03-25 01:30:00",)], "a string").select(F.col("a").cast("timestamp_ntz").alias("a"))
    out = []
    for tz in ("UTC", "Europe/London", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        out.append(tuple(df.select(iso_z(F.col("a")), created_display(F.col("a")),
                                   elapsed_days(F.col("a"), as_of_lit("2001-07-31 12:00:00"))).first()))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(set(out)) == 1 and out[0][0] == "2001-03-25T01:30:00Z"


@pytest.mark.parametrize("day,text", [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"),
                                      (13, "13th"), (21, "21st"), (22, "22nd"), (23, "23rd"), (31, "31st")])
def test_ordinal(spark, day, text):
    assert one(spark, ordinal(F.col("x")), "x int", day) == text


def test_rendered_dates(spark):
    df = spark.createDataFrame([("2001-02-06 12:14:00",), ("2001-08-03 00:05:00",)], "a string") \
        .select(F.col("a").cast("timestamp_ntz").alias("t"))
    rows = df.select(created_display(F.col("t")).alias("c"), expiry_phrase(F.col("t")).alias("p"),
                     iso_z(add_hours(F.col("t"), F.lit(1.5))).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("Tue  6 Feb, 12:14 pm", "Tuesday 6th of February", "2001-02-06T13:44:00Z"),
                                        ("Fri  3 Aug, 00:05 am", "Friday 3rd of August", "2001-08-03T01:35:00Z")]


@pytest.mark.parametrize("days,label", [(0, "Today"), (1, "1 day ago"), (2, "2 days ago"), (-3, "-3 days ago")])
def test_age_label(spark, days, label):
    assert one(spark, age_label(F.col("x")), "x bigint", days) == label


@pytest.mark.parametrize("age,strict,expected", [
    (30, True, ""), (31, True, "warning"), (60, True, "warning"), (61, True, "danger"), (None, True, ""),
    (6, False, ""), (7, False, "warning"), (14, False, "danger")])
def test_severity(spark, age, strict, expected):
    warn, danger = (30, 60) if strict else (7, 14)
    assert one(spark, severity(F.col("x"), warn, danger, strict), "x bigint", age) == expected


def test_small_renderers(spark):
    df = spark.createDataFrame([("a.b.c", 150, None), ("x", 149, "0"), (None, -350, "")], "h string, p bigint, o string")
    rows = df.select(short_name(F.col("h")), to_pounds(F.col("p")), owner_or_unknown(F.col("o"), True),
                     owner_or_unknown(F.col("o"), False)).collect()
    assert [tuple(r) for r in rows] == [("a", 2, "Unknown", "Unknown"), ("x", 1, "Unknown", "0"),
                                        (None, -3, "Unknown", "Unknown")]


def test_comma_list(spark):
    from opsdeck.functions.text import comma_list
    vals = ["a,b,c", "a,,b", "a,b,,", "x", "", "0", None]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    assert [r.r for r in df.select(comma_list(F.col("x")).alias("r")).collect()] == \
        ["a, b, c", "a, , b", "a, b", "x", "n/a", "n/a", "n/a"]


def test_lenient_decode_matches_python_unquote(spark):
    import random
    import urllib.parse

    from opsdeck.functions.urls import lenient_url_decode

    rng = random.Random(2024)
    atoms = ["%", "%2", "%2F", "%2f", "%41", "%zz", "%C3%A9", "%C3", "%A9", "%E2%82%AC", "%E2%82", "%F0%9F%98%80",
             "%ff", "%80", "%C0%AF", "+", "a", "Z", "/", "?", "&", "=", "é", "€", "0", "9", "F", " ", "%%", "%+1", "%-1"]
    atoms += ["%ED%A0%80", "%ed%bf%bf", "%ED%9F%BF", "%ED", "%E0%80", "%F4%90%80%80"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, u string")
    got = {r.i: r.d for r in df.select("i", lenient_url_decode(F.col("u")).alias("d")).collect()}
    bad = [(t, got[i], urllib.parse.unquote(t)) for i, t in enumerate(texts) if got[i] != urllib.parse.unquote(t)]
    assert not bad, bad[:5]


def test_url_rules_match_python_re(spark):
    import random
    import re

    from opsdeck.functions.urls import default_url_rules, normalize_url

    rules = default_url_rules("REF")
    compiled = [(re.compile(p, re.ASCII), r) for p, r in rules]
    rng = random.Random(99)
    atoms = ["/", "12", "7", "REF", "REFabc", "jp/journeys/", "x", "/calling-points", "a", "\r", "\n", "\u0085",
             "\u2028", "é", "$1", "\\", ".", " "]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, u string")
    got = {r.i: r.n for r in df.select("i", normalize_url(F.col("u"), rules).alias("n")).collect()}

    def python(t):
        for p, r in compiled:
            t = p.sub(r, t)
        return t

    bad = [(t, got[i], python(t)) for i, t in enumerate(texts) if got[i] != python(t)]
    assert not bad, bad[:5]
