"""Access-log parsing, decoding, URL rules and endpoint statistics (edge cases + differential)."""

from __future__ import annotations

import os
import random
import re
import tempfile
import urllib.parse

import pytest
from pyspark.sql import functions as F

from opsdeck.constants import LOG_PATTERN
from opsdeck.functions.urls import default_url_rules, lenient_url_decode, normalize_url
from opsdeck.operators.access_log import parse_access_log
from opsdeck.plans.traffic import endpoint_stats
from opsdeck.sources.logs import read_access_log

RULES = default_url_rules("REF")


def line(url="/a", method="GET", tt="69", status=200, size=100, cookie="-", marker="edge_proxy"):
    return (f"Jan  1 00:00:00 lb {marker}[1]: 10.0.0.1:5 [t] fe be/s1 10/0/30/{tt}/{tt} {status} {size} "
            f"{cookie} - ---- 1/1/1/1/0 0/0 \"{method} {url} HTTP/1.1\"")


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


@pytest.mark.parametrize("strategy", ["single", "extract"])
def test_parse_filters(spark, strategy):
    rows = [
        line(marker="other"),            # no marker
        line(method="OPTIONS"),          # method not listed
        line(tt="+5"),                   # signed timer
        line(tt="-1"),
        line(cookie="abc"),              # captured request cookie
        line(url="/ok", status=302),     # kept
    ]
    out = parse_access_log(lines_df(spark, rows), "edge_proxy", strategy=strategy).collect()
    assert [(r.method, r.url, r.status, r.resp_bytes, r.resp_time_ms) for r in out] == [("GET", "/ok", 302, 100, 69.0)]


def test_endpoint_stats_counts_and_buckets(spark):
    rows = [line(url="/a/1", status=200, size=10, tt="10"), line(url="/a/2", status=302, size=30, tt="30"),
            line(url="/a/3", status=404, size=20, tt="20"), line(url="/a/4", status=503, size=0, tt="0"),
            line(url="/b", method="POST", status=201)]
    out = {(r.method, r.url): r for r in endpoint_stats(lines_df(spark, rows), "edge_proxy", RULES).collect()}
    a = out[("GET", "/a/[id]")]
    assert (a.requests, a.n_2xx, a.n_4xx, a.n_5xx) == (4, 1, 1, 1)
    assert a.avg_resp_time_ms == pytest.approx(15.0) and a.avg_resp_bytes == pytest.approx(15.0)
    assert a.n_2xx + a.n_4xx + a.n_5xx <= a.requests


def test_top_n_order_and_ties(spark):
    rows = [line(url="/x")] * 3 + [line(url="/b")] * 2 + [line(url="/a")] * 2 + [line(url="/c")]
    out = endpoint_stats(lines_df(spark, rows), "edge_proxy", RULES, limit=3).collect()
    assert [(r.url, r.requests) for r in out] == [("/x", 3), ("/a", 2), ("/b", 2)]


CASES = [
    ("/a/12/b", "/a/[id]/b"),
    ("/123abc", "/[id]abc"),
    ("/jp/journeys/abc/calling-points", "/jp/journeys/[fare_id]/calling-points"),
    ("/jp/journeys/x%2Fy/calling-points", "/jp/journeys/x/y/calling-points"),
    ("/REFabcdefgh/xyz/9", "/[id]yz/[id]"),
    ("/s?q=a+b%20c%zz&d=100%", "/s?q=a+b c%zz&d=100%"),
    ("%ff%fe", "��"),
]


@pytest.mark.parametrize("raw,expected", CASES)
def test_decode_and_rules(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "url string")
    got = df.select(normalize_url(lenient_url_decode(F.col("url")), RULES).alias("u")).first().u
    assert got == expected


def _python_reference(lines):
    """Brute force with Python's re and urllib, the semantics the operator follows."""
    pattern = re.compile(LOG_PATTERN, re.ASCII)
    subs = [(re.compile(p, re.ASCII), r) for p, r in RULES]
    stats = {}
    for text in lines:
        if "edge_proxy" not in text:
            continue
        m = pattern.search(text)
        if not m:
            continue
        t, status, size, method, url = m.groups()
        url = urllib.parse.unquote(url)
        for p, r in subs:
            url = p.sub(r, url)
        s = stats.setdefault((method, url), [0, 0.0, 0, 0, 0, 0])
        s[0] += 1
        s[1] += float(t)
        s[2] += int(size)
        st = int(status)
        s[3] += 200 <= st < 300
        s[4] += 400 <= st < 500
        s[5] += 500 <= st < 600
    return {k: (v[0], v[1] / v[0], v[2] / v[0], v[3], v[4], v[5]) for k, v in stats.items()}


def _random_url(rng):
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.25:
            parts.append(str(rng.randint(0, 99999)))
        elif kind < 0.4:
            parts.append("REF" + "".join(rng.choice("abc/%2F09") for _ in range(rng.randint(0, 14))))
        elif kind < 0.5:
            parts.append("jp/journeys/" + rng.choice(["f1", "x%2Fy", "%41b"]) + "/calling-points")
        else:
            parts.append("".join(rng.choice("abz+%2Fe0%zZ9é") for _ in range(rng.randint(1, 8))))
    return "/" + "/".join(parts) + rng.choice(["", "?q=a+b%20c", "?x=%", "%C3%A9", "%ff"])


def test_differential_against_python_re(spark):
    rng = random.Random(7)
    lines = []
    for _ in range(400):
        lines.append(line(url=_random_url(rng), method=rng.choice(["GET", "POST", "HEAD", "OPTIONS"]),
                          tt=rng.choice(["5", "120", "+5", "-1"]), status=rng.choice([200, 302, 404, 500, 101]),
                          size=rng.randint(0, 5000), cookie=rng.choice(["-", "-", "c=1"]),
                          marker=rng.choice(["edge_proxy", "edge_proxy", "other"])))
    expected = _python_reference(lines)
    got = {(r.method, r.url): (r.requests, r.avg_resp_time_ms, r.avg_resp_bytes, r.n_2xx, r.n_4xx, r.n_5xx)
           for r in endpoint_stats(lines_df(spark, lines), "edge_proxy", RULES, limit=None).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k][0] == v[0] and got[k][3:] == v[3:]
        assert got[k][1] == pytest.approx(v[1]) and got[k][2] == pytest.approx(v[2])


def test_strategies_agree(spark):
    rng = random.Random(11)
    lines = [line(url=_random_url(rng), tt=rng.choice(["1", "+2"]), cookie=rng.choice(["-", "x"])) for _ in range(200)]
    df = lines_df(spark, lines)
    a = sorted(parse_access_log(df, "edge_proxy", strategy="single").collect())
    b = sorted(parse_access_log(df, "edge_proxy", strategy="extract").collect())
    assert a == b and len(a) > 0


def test_read_access_log_folder_rules(spark):
    folder = tempfile.mkdtemp(prefix="opsdeck-logs-")
    os.makedirs(os.path.join(folder, "sub.log"))
    for name in ["a.log", "b.tsv", "c.txt", ".h.log", os.path.join("sub.log", "n.log")]:
        with open(os.path.join(folder, name), "w") as f:
            f.write(line(url="/" + os.path.basename(name).replace(".", "_")) + "\n")
    urls = sorted(r.url for r in parse_access_log(read_access_log(spark, folder), "edge_proxy").collect())
    assert urls == ["/a_log", "/b_tsv"]


def test_oversized_numbers_do_not_fail_the_job(spark):
    # status and size wider than bigint become null (the job keeps running under ANSI mode)
    rows = [line(url="/big", status=200, size=10**25), line(url="/big", status=200, size=5)]
    out = parse_access_log(lines_df(spark, rows), "edge_proxy").collect()
    assert sorted((r.resp_bytes is None, r.status) for r in out) == [(False, 200), (True, 200)]
    stats = endpoint_stats(lines_df(spark, rows), "edge_proxy", RULES).first()
    assert stats.requests == 2 and stats.n_2xx == 2


def test_invalid_utf8_in_files_is_replaced(spark):
    folder = tempfile.mkdtemp(prefix="opsdeck-bytes-")
    with open(os.path.join(folder, "a.log"), "wb") as f:
        f.write(line(url="/x\xffy").encode("latin-1") + b"\n" + line(url="/ok").encode() + b"\n")
    urls = sorted(r.url for r in endpoint_stats(read_access_log(spark, folder), "edge_proxy", RULES).collect())
    assert urls == ["/ok", "/x�y"]
