"""Incremental ingestion of a log folder that receives files between runs."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

from opsdeck.functions.urls import default_url_rules
from opsdeck.plans.traffic import endpoint_stats
from opsdeck.sources.logs import read_access_log
from opsdeck.streaming.log_stream import endpoint_stats_ingested, requests_stream, start_ingest
from test_access_log import line

RULES = default_url_rules("REF")


def _write(folder, name, lines):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _stats(df):
    return {(r.method, r.url): (r.requests, r.n_2xx, r.n_4xx, r.n_5xx) for r in df.collect()}


def test_stream_matches_batch_incrementally(spark):
    folder = tempfile.mkdtemp(prefix="opsdeck-stream-in-")
    work = tempfile.mkdtemp(prefix="opsdeck-stream-")
    output, checkpoint = os.path.join(work, "requests"), os.path.join(work, "ckpt")
    _write(folder, "a.log", [line(url="/a/1"), line(url="/a/2", status=404), line(url="/b", marker="other")])
    _write(folder, "skip.txt", [line(url="/never")])

    def run():
        stream = requests_stream(spark, folder, "edge_proxy", RULES)
        start_ingest(stream, output, checkpoint=checkpoint, available_now=True).awaitTermination()

    def batch():
        return _stats(endpoint_stats(read_access_log(spark, folder), "edge_proxy", RULES, limit=None))

    run()
    assert _stats(endpoint_stats_ingested(spark, output)) == batch() == {("GET", "/a/[id]"): (2, 1, 1, 0)}
    _write(folder, "b.tsv", [line(url="/a/3", status=500), line(url="/c", method="POST")])
    run()  # restarted query: reads only the new file
    run()  # nothing new: no duplicates
    expected = {("GET", "/a/[id]"): (3, 1, 1, 1), ("POST", "/c"): (1, 1, 0, 0)}
    assert _stats(endpoint_stats_ingested(spark, output)) == batch() == expected
    assert spark.read.parquet(output).count() == 4


def test_a_second_application_continues(spark):
    """The default checkpoint lies beside the table, so another application finds it (Spark's own
    checkpoint folder is another one in each application)."""
    folder = tempfile.mkdtemp(prefix="opsdeck-stream-in-")
    output = os.path.join(tempfile.mkdtemp(prefix="opsdeck-stream-"), "requests")
    script = (
        "import sys; sys.path[:0] = [%r]\n"
        "from opsdeck.session import build_session\n"
        "from opsdeck.functions.urls import default_url_rules\n"
        "from opsdeck.streaming.log_stream import requests_stream, start_ingest\n"
        "spark = build_session('local[2]', shuffle_partitions=2, extra={'spark.checkpoint.dir': %r})\n"
        "start_ingest(requests_stream(spark, %r, 'edge_proxy', default_url_rules('REF')), %r,"
        " available_now=True).awaitTermination()\n"
    ) % (os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tempfile.mkdtemp(prefix="opsdeck-ck-"), folder, output)
    for name, url in (("a.log", "/one/x"), ("b.log", "/two/x")):
        _write(folder, name, [line(url=url)])
        subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=300)
    assert _stats(endpoint_stats_ingested(spark, output)) == {("GET", "/one/x"): (1, 1, 0, 0), ("GET", "/two/x"): (1, 1, 0, 0)}
