"""Inventory and broker snapshots read from JSON files, then flattened."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

import pytest

from opsdeck.operators.nested import flatten_instances
from opsdeck.sources.inventory import read_brokers, read_inventory

DOC = {"Reservations": [
    {"Instances": [
        {"InstanceId": "i-1", "LaunchTime": "2001-07-01T10:00:00.000Z", "PrivateIpAddress": "10.0.0.1",
         "State": {"Name": "running"},
         "Tags": [{"Key": "role", "Value": "prod"}, {"Key": "build", "Value": "a"}, {"Key": "role", "Value": "test"}]},
        {"InstanceId": "i-2", "LaunchTime": "2001-07-02T10:00:00Z", "State": {"Name": "stopped"}},
    ]},
    {"Instances": []},
    {"Instances": [{"InstanceId": "i-3", "LaunchTime": "2001-07-03T10:00:00.000Z", "State": {"Name": "running"},
                    "Tags": [{"Key": "build", "Value": "b"}], "Unused": 1}]},
]}


def _folder(files):
    folder = tempfile.mkdtemp(prefix="opsdeck-src-")
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return folder


def test_read_and_flatten_api_response(spark):
    folder = _folder({"page1.json": json.dumps(DOC, indent=2)})
    rows = flatten_instances(read_inventory(spark, folder)).orderBy("res_pos", "inst_pos").collect()
    got = [(r.res_pos, r.inst_pos, r.instance_id, r.launch_time, r.private_ip, r.state, r.tags) for r in rows]
    assert got == [
        (0, 0, "i-1", dt.datetime(2001, 7, 1, 10), "10.0.0.1", "running", {"build": "a", "role": "test"}),
        (0, 1, "i-2", dt.datetime(2001, 7, 2, 10), None, "stopped", {}),
        (2, 0, "i-3", dt.datetime(2001, 7, 3, 10), None, "running", {"build": "b"}),
    ]


def test_json_lines_pages(spark):
    page2 = {"page": 2, "Reservations": [{"Instances": [{"InstanceId": "i-9", "State": {"Name": "running"}}]}]}
    folder = _folder({"pages.json": json.dumps({"page": 1, **DOC}) + "\n" + json.dumps(page2) + "\n"})
    rows = flatten_instances(read_inventory(spark, folder, json_lines=True)).collect()
    assert sorted((r.page, r.instance_id) for r in rows) == [(1, "i-1"), (1, "i-2"), (1, "i-3"), (2, "i-9")]


def _owner_page(owner, **page):
    return json.dumps({**page, "Reservations": [{"Instances": [{
        "InstanceId": f"i-{owner}", "LaunchTime": "2001-07-01T10:00:00.000Z", "State": {"Name": "running"},
        "Tags": [{"Key": "role", "Value": "test"}, {"Key": "build", "Value": "a"},
                 {"Key": "launched_by_name", "Value": owner}]}]}]})


def test_pages_are_ordered_by_number_not_by_text(spark):
    from report_helpers import AS_OF
    from opsdeck.plans import listings
    folder = _folder({f"page-{k}.json": _owner_page(f"page{k}") for k in range(1, 11)})
    inst = flatten_instances(read_inventory(spark, folder))
    assert [r.owner for r in listings.running_listing(inst, AS_OF).collect()] == ["page10"]


def test_many_documents_in_one_file_have_one_order(spark):
    from report_helpers import AS_OF
    from opsdeck.plans import listings
    folder = _folder({"all.json": "\n".join(_owner_page(f"line{k:04d}", page=k) for k in range(500))})
    flat = flatten_instances(read_inventory(spark, folder, json_lines=True))
    for inst in (flat, flat.repartition(3), flat.repartition(7, "instance_id")):
        assert [r.owner for r in listings.running_listing(inst, AS_OF).collect()] == ["line0499"]


def test_documents_without_an_order_are_refused(spark):
    same = _folder({"all.json": _owner_page("x", page=1) + "\n" + _owner_page("y", page=1)})
    none = _folder({"all.json": _owner_page("x") + "\n" + _owner_page("y")})
    mixed = _folder({"all.json": _owner_page("x") + "\n" + _owner_page("y", page=4)})
    for folder in (same, none, mixed):
        with pytest.raises(ValueError, match="page number of its own"):
            read_inventory(spark, folder, json_lines=True)
    assert read_inventory(spark, same, json_lines=True, check=False).count() == 2
    single = _folder({"all.json": _owner_page("x")})
    assert [r.page for r in read_inventory(spark, single, json_lines=True).collect()] == [0]


def test_read_brokers(spark):
    doc = {"BrokerSummaries": [{"BrokerId": "b-1", "BrokerName": "a-rabbit-dev"},
                               {"BrokerId": "b-2", "BrokerName": "a-rabbit-dev-2"}]}
    folder = _folder({"brokers.json": json.dumps(doc, indent=1)})
    rows = read_brokers(spark, folder, with_page=False).collect()
    assert [tuple(r) for r in rows] == [(0, "b-1", "a-rabbit-dev"), (1, "b-2", "a-rabbit-dev-2")]


def test_last_broker_wins_across_files(spark):
    from opsdeck.plans.listings import broker_links
    folder = _folder({"p1.json": json.dumps({"BrokerSummaries": [{"BrokerId": "old", "BrokerName": "a-rabbit-dev"},
                                                                 {"BrokerId": "x", "BrokerName": "z-rabbit-dev"}]}),
                      "p2.json": json.dumps({"BrokerSummaries": [{"BrokerId": "new", "BrokerName": "a-rabbit-dev"}]})})
    links = {r.build: r.rabbit for r in broker_links(read_brokers(spark, folder)).collect()}
    assert links["a"] == "https://new.mq.eu-west-1.on.aws"


def test_last_wins_across_pages(spark):
    from report_helpers import AS_OF
    from opsdeck.plans import listings

    def page(instance_id, owner):
        return json.dumps({"Reservations": [{"Instances": [{
            "InstanceId": instance_id, "LaunchTime": "2001-07-01T10:00:00.000Z", "State": {"Name": "running"},
            "Tags": [{"Key": "role", "Value": "test"}, {"Key": "build", "Value": "a"},
                     {"Key": "launched_by_name", "Value": owner}]}]}]})
    folder = _folder({"p1.json": page("i-1", "first"), "p2.json": page("i-2", "second")})
    inst = flatten_instances(read_inventory(spark, folder))
    assert [r.owner for r in listings.running_listing(inst, AS_OF).collect()] == ["second"]


def test_read_inventory_without_page(spark):
    folder = _folder({"page1.json": json.dumps(DOC)})
    docs = read_inventory(spark, folder, with_page=False)
    assert docs.columns == ["Reservations"]
    flat = flatten_instances(docs)
    assert "page" not in flat.columns and flat.count() == 3
