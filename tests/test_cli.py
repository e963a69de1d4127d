"""The command line builds the same reports."""

from __future__ import annotations

import json
import os
import tempfile

from opsdeck.__main__ import main
from test_access_log import line
from test_sources import DOC, _folder


def test_cli_endpoint_stats(spark):
    folder = tempfile.mkdtemp(prefix="opsdeck-cli-")
    with open(os.path.join(folder, "a.log"), "w") as f:
        f.write("\n".join([line(url="/a/1", marker="haproxy"), line(url="/a/2", marker="haproxy"),
                           line(url="/b", marker="other")]) + "\n")
    out = os.path.join(tempfile.mkdtemp(prefix="opsdeck-cli-out-"), "stats")
    assert main(["--out", out, "endpoint-stats", folder]) == 0
    rows = [(r.method, r.url, r.requests) for r in spark.read.parquet(out).collect()]
    assert rows == [("GET", "/a/[id]", 2)]


def test_cli_inventory_reports(spark):
    inventory = _folder({"page.json": json.dumps(DOC)})
    out = os.path.join(tempfile.mkdtemp(prefix="opsdeck-cli-out-"), "plan")
    assert main(["--out", out, "--as-of", "2001-07-31 12:00:00", "running-listing", inventory]) == 0
    # i-3 (build b) has no role tag, so only build a is in the test fleet
    assert sorted(r.build for r in spark.read.parquet(out).collect()) == ["a"]
    assert main(["--as-of", "2001-07-31 12:00:00", "costs", inventory, "--by", "owner"]) == 0


def test_cli_every_inventory_command(spark, capsys):
    inventory = _folder({"page.json": json.dumps(DOC)})
    brokers = _folder({"b.json": json.dumps({"BrokerSummaries": [{"BrokerId": "b-1", "BrokerName": "a-rabbit-dev"}]})})
    base = ["--as-of", "2001-07-31 12:00:00", "--show", "5"]
    commands = [["fleet-listing", inventory, brokers], ["running-listing", inventory], ["age-digest", inventory, "3"],
                ["expiry-digest", inventory, "5"], ["costs", inventory, "--by", "age"], ["costs", inventory],
                ["nightly-plan", inventory], ["morning-plan", inventory], ["extend-lifetime", inventory, "a", "2.5"]]
    for cmd in commands:
        assert main(base + cmd) == 0, cmd
    out = capsys.readouterr().out
    assert "https://b-1.mq.eu-west-1.on.aws" in out      # fleet listing joined the broker
    assert "total_instances" in out                      # cost totals printed


def test_cli_json_lines(spark):
    pages = [{"page": k, **DOC} for k in (1, 2)]
    inventory = _folder({"pages.json": "\n".join(json.dumps(p) for p in pages)})
    out = os.path.join(tempfile.mkdtemp(prefix="opsdeck-cli-out-"), "plan")
    assert main(["--out", out, "--json-lines", "--as-of", "2001-07-31 12:00:00", "running-listing", inventory]) == 0
    assert [r.build for r in spark.read.parquet(out).collect()] == ["a"]
