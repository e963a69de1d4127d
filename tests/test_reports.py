"""Inventory reports on small hand-built fleets (semantics notes and invariants)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from report_helpers import AS_OF, ago, iso, make_instances
from opsdeck.operators.collapse import first_by, last_by
from opsdeck.operators.nested import flatten_instances, nest_instances
from opsdeck.plans import costs, digests, lifecycle, listings

BROKER_SCHEMA = "pos bigint, broker_id string, broker_name string"


def t(**kw):
    base = {"role": "test"}
    base.update(kw)
    return {k: v for k, v in base.items() if v is not None}


def test_flatten_nest_round_trip(spark):
    rows = [{"res_pos": r, "inst_pos": i, "instance_id": f"i-{r}-{i}", "launch": ago(r),
             "tags": t(build=f"b{r}", hostname=None if i else "h.example.test")} for r in range(25) for i in range(3)]
    flat = make_instances(spark, rows)
    back = flatten_instances(nest_instances(flat, page_size=10))
    got = back.select((F.col("page") * 10 + F.col("res_pos")).alias("res_pos"), "inst_pos", "instance_id",
                      "launch_time", "private_ip", "state", "tags")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, flat.collect()))


def test_last_by_whole_row_and_fieldwise(spark):
    df = spark.createDataFrame([("a", 1, "x", "warning"), ("a", 2, "y", None), ("a", 0, "z", "danger"),
                                ("b", 5, "q", None)], "k string, pos int, v string, sev string")
    whole = {r.k: (r.pos, r.v, r.sev) for r in last_by(df, ["k"], ["pos"]).collect()}
    assert whole == {"a": (2, "y", None), "b": (5, "q", None)}
    field = {r.k: (r.v, r.sev) for r in last_by(df, ["k"], ["pos"], keep_last_set=["sev"]).collect()}
    assert field == {"a": ("y", "warning"), "b": ("q", None)}
    first = {r.k: r.v for r in first_by(df, ["k"], ["pos"]).collect()}
    assert first == {"a": "z", "b": "q"}


def _brokers(spark, rows):
    return spark.createDataFrame(rows, BROKER_SCHEMA)


def test_fleet_listing(spark):
    inst = make_instances(spark, [
        {"instance_id": "i-1", "state": "stopped", "tags": t(build="Zeta", hostname="Zeta.Example.test",
                                                             launched_by_name="", launched_at=iso(ago(61, -1)))},
        {"instance_id": "i-2", "state": "running", "tags": t(build="alpha", hostname="alpha.x", launched_by_name="0",
                                                             launched_at=iso(ago(31), millis=False))},
        {"instance_id": "i-3", "state": "running", "tags": t(build="Zeta", hostname="Zeta.Example.test",
                                                             launched_by_name="ann", launched_at=iso(ago(0)))},
        {"instance_id": "i-4", "state": "running", "tags": t(build="skipme", launched_at=iso(ago(1)))},
        {"instance_id": "i-5", "state": "running", "tags": t(role="prod", build="other")},
        {"instance_id": "i-6", "state": "running", "tags": {"role": "test"}},
    ])
    brokers = _brokers(spark, [(1, "b1", "Zeta-rabbit-dev"), (2, "b2", "Zeta-rabbit-dev-2"), (3, "b3", "ghost-rabbit-dev")])
    out = listings.fleet_listing(inst, brokers, AS_OF, exclude_builds=("skipme",)).collect()
    assert [r.build for r in out] == ["alpha", "Zeta"]  # running first, then lower-cased name
    alpha, zeta = out
    assert (alpha.owner, alpha.age_days, alpha.severity, alpha.age_label, alpha.rabbit) == ("0", 31, "warning", "31 days ago", "")
    assert (zeta.owner, zeta.age_days, zeta.severity, zeta.age_label, zeta.running) == ("ann", 0, "", "Today", True)
    assert (zeta.status_label, zeta.status_color) == ("Running", "#28a745")
    assert zeta.rabbit == "https://b2.mq.eu-west-1.on.aws"
    assert zeta.website == "https://www.Zeta.Example.test" and zeta.portainer == "http://Zeta.Example.test:9000"


def test_running_listing_fieldwise_and_fallback(spark):
    inst = make_instances(spark, [
        {"instance_id": "i-1", "launch": ago(20), "tags": t(build="my_box", launched_by_name="0")},
        {"instance_id": "i-2", "launch": ago(20), "tags": t(build="my_box", no_age_alert="", launched_by_name="bo")},
        {"instance_id": "i-3", "launch": ago(40), "tags": t(build="Up", hostname="Up.Example.TEST",
                                                            launched_at=iso(ago(8)))},
        {"instance_id": "i-4", "state": "stopped", "tags": t(build="down")},
        {"instance_id": "i-5", "tags": t(build="0")},
    ])
    out = {r.build: r for r in listings.running_listing(inst, AS_OF, domain="example.test").collect()}
    assert sorted(out) == ["Up", "my_box"]
    box = out["my_box"]
    # last instance wins, except the severity it skipped (no_age_alert) keeps the earlier value
    assert (box.owner, box.age_days, box.severity, box.hostname) == ("bo", 20, "danger", "my-box.example.test")
    assert box.website == "https://www.my-box.example.test" and box.expires == "n/a"
    up = out["Up"]
    assert (up.hostname, up.age_days, up.severity, up.overdue) == ("up.example.test", 8, "warning", False)
    assert up.portainer == "http://Up.Example.TEST:9000"


def _owned(spark):
    return make_instances(spark, [
        {"instance_id": "i-1", "launch": ago(5), "tags": t(build="a", launched_by_email="x@e", launched_at=iso(ago(5)),
                                                           terminate_after=iso(ago(-3, -1)))},
        {"instance_id": "i-2", "launch": ago(1), "tags": t(build="a", launched_by_email="x@e", launched_at=iso(ago(1)),
                                                           terminate_after=iso(ago(-30)))},
        {"instance_id": "i-3", "launch": ago(9), "tags": t(build="b", launched_by_email="x@e", launched_at=iso(ago(0, 2)),
                                                           terminate_after=iso(ago(2, 1)))},
        {"instance_id": "i-4", "launch": ago(9), "tags": t(build="c", launched_by_email="bot@e")},
        {"instance_id": "i-5", "launch": ago(9), "tags": t(build="d", launched_by_email="")},
        {"instance_id": "i-6", "launch": ago(3), "tags": t(build="e", launched_by_email="y@e", terminate_after="")},
    ])


def test_age_digest_filters_before_collapse(spark):
    out = digests.age_digest(_owned(spark), AS_OF, min_days=2, ignore_owner="bot@e").collect()
    got = [(r.owner, r.build, r.age_days, r.n_instances) for r in out]
    # i-2 (a, 1 day) is filtered out before the collapse, so a keeps i-1's age
    assert got == [("x@e", "a", 5, 2), ("x@e", "b", 9, 2), ("y@e", "e", 3, 1)]
    assert out[0].subject.endswith("You have 2 running instances") and out[2].subject.endswith("1 running instance")
    assert out[0].item_text == "a, running for 5 days"


def test_expiry_digest(spark):
    out = digests.expiry_digest(_owned(spark), AS_OF, within_days=8, ignore_owner="bot@e").collect()
    got = [(r.build, r.age_days, r.expires_days) for r in out]
    assert got == [("a", 5, 3), ("b", 0, -2)]
    assert out[1].item_text.startswith("b, created less than a day ago will be terminated on the evening of ")
    assert out[0].expires_on == "Friday 3rd of August"


def test_costs(spark):
    inst = make_instances(spark, [
        {"instance_id": "i-1", "launch": ago(2, 1), "state": "stopped", "tags": t(hostname="one.x.y", launched_by_name="ann")},
        {"instance_id": "i-2", "launch": ago(0, 5), "tags": t(hostname="two.x", launched_by_name="ann")},
        {"instance_id": "i-3", "launch": ago(10), "tags": t(hostname="three")},
        {"instance_id": "i-4", "launch": ago(10), "tags": t(role="prod", hostname="nope")},
    ])
    rows = costs.cost_rows(inst, AS_OF)
    tot = costs.cost_totals(rows).first()
    assert (tot.total_instances, tot.total_days, tot.total_price_pence, tot.todays_price_pence) == (3, 12, 8400, 2100)
    assert (tot.total_price_pounds, tot.todays_price_pounds) == (84, 21)
    boxes = [(r.short_name, r.age_days, r.item_text) for r in costs.cost_by_box(rows).collect()]
    assert boxes == [("three", 10, "_*three*_: 10d, £70"), ("one", 2, "_*one*_: 2d, £14"), ("two", 0, "_*two*_: 0d, £0")]
    owners = [(r.owner, r.instance_count, r.instance_days) for r in costs.cost_by_owner(rows).collect()]
    assert sorted(owners, key=str) == sorted([("ann", 2, 2), (None, 1, 10)], key=str)
    assert sum(o[1] for o in owners) == tot.total_instances
    empty = costs.cost_totals(rows.limit(0)).first()
    assert (empty.total_instances, empty.total_days, empty.total_price_pence) == (0, 0, 0)


def test_lifecycle_plans(spark):
    inst = make_instances(spark, [
        {"instance_id": "i-1", "tags": t(Name="one", terminate_after=iso(AS_OF))},
        {"instance_id": "i-2", "tags": t(Name="two", terminate_after=iso(ago(0, 12), millis=False))},
        {"instance_id": "i-3", "tags": t(Name="three", terminate_after="")},
        {"instance_id": "i-4", "tags": t(Name="four", terminate_after="garbage")},
        {"instance_id": "i-5", "tags": t(Name="five", terminate_after=iso(ago(-3)))},
        {"instance_id": "i-6", "tags": t(Name="six")},
        {"instance_id": "i-7", "state": "stopped", "tags": t(Name="seven", terminate_after="")},
        {"instance_id": "i-8", "state": "stopped", "tags": t(Name="eight")},
    ])
    night = {r.instance_id: (r.expires_days, r.action) for r in lifecycle.nightly_plan(inst, AS_OF).collect()}
    assert night == {"i-1": (0, "stop"), "i-2": (0, "terminate"), "i-3": (None, "stop"), "i-4": (None, "stop"),
                     "i-5": (3, "stop")}
    morning = [r.instance_id for r in lifecycle.morning_plan(inst).collect()]
    assert morning == ["i-7"] and not set(morning) & set(night)


def test_extend_lifetime(spark):
    inst = make_instances(spark, [
        {"instance_id": "i-1", "tags": t(build="a", Name="first", terminate_after="2001-08-01T10:00:00.000Z")},
        {"instance_id": "i-2", "tags": t(build="a", Name="second", terminate_after="2001-08-09T10:00:00.000Z")},
        {"instance_id": "i-3", "tags": t(build="b")},
    ])
    req = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("zz", 1.0), ("a", 0.5)], "build string, hours double")
    out = [tuple(r) for r in lifecycle.extend_lifetime(inst, req).collect()]
    assert out == [("a", 2, 1.5, "i-1", "first", dt.datetime(2001, 8, 1, 10), dt.datetime(2001, 8, 1, 11, 30),
                    "2001-08-01T11:30:00Z")]


def test_listing_counts_equal_listing_sizes(spark):
    inst = make_instances(spark, [
        {"instance_id": "i-1", "tags": t(build="a")}, {"instance_id": "i-2", "tags": t(build="a")},
        {"instance_id": "i-3", "state": "stopped", "tags": t(build="b")},
        {"instance_id": "i-4", "tags": t(build="0")}, {"instance_id": "i-5", "tags": t(build="skip")},
        {"instance_id": "i-6", "tags": {"role": "test"}}, {"instance_id": "i-7", "tags": t(role="prod", build="p")},
    ])
    brokers = _brokers(spark, [])
    fleet = listings.fleet_listing(inst, brokers, AS_OF, exclude_builds=("skip",)).count()
    running = listings.running_listing(inst, AS_OF).count()
    got = listings.listing_counts(inst, exclude_builds=("skip",)).first()
    # fleet: a, b, "0" ("skip" excluded); running: a, skip (R3 has no exclusion list)
    assert (got.n_fleet_builds, got.n_running_builds) == (fleet, running) == (3, 2)


def test_digest_with_a_hot_owner(spark):
    rows = []
    for i in range(3000):
        owner = "hot@e" if i % 3 else f"u{i % 7}@e"
        rows.append({"instance_id": f"i-{i}", "launch": ago(3 + i % 5),
                     "tags": t(build=f"b{i % 400}", launched_by_email=owner)})
    inst = make_instances(spark, rows).repartition(8)
    out = digests.age_digest(inst, AS_OF, min_days=2, ignore_owner="none@e")
    per_owner = {r.owner: (r.n, r.k) for r in out.groupBy("owner").agg(F.count("*").alias("n"),
                                                                       F.max("n_instances").alias("k")).collect()}
    assert all(n == k for n, k in per_owner.values())          # header count equals its item rows
    hot_builds = {f"b{i % 400}" for i in range(3000) if i % 3}
    assert per_owner["hot@e"][0] == len(hot_builds)
    # each item keeps the age of the last listed instance of that (owner, build)
    last_age = {}
    for i in range(3000):
        if i % 3:
            last_age[f"b{i % 400}"] = 3 + i % 5
    got = {r.build: r.age_days for r in out.filter(F.col("owner") == "hot@e").collect()}
    assert got == last_age


def test_orders_of_the_sorted_reports(spark):
    """The rows of each report in the order its readers see."""
    rows = [{"instance_id": f"i-{k}", "launch": ago(1 + (k * 7) % 4), "state": "running" if k % 3 else "stopped",
             "tags": t(build=f"b{(k * 5) % 9}", hostname=f"h{k % 4}.example.test", launched_by_name=f"n{k % 3}",
                       launched_by_email=f"u{k % 2}@e", launched_at=iso(ago(2)), terminate_after=iso(ago(-1)))}
            for k in range(24)]
    inst = make_instances(spark, rows).repartition(5)
    fleet = [(not r.running, r.build.lower()) for r in listings.fleet_listing(inst, _brokers(spark, []), AS_OF).collect()]
    assert fleet == sorted(fleet)
    running = [r.build for r in listings.running_listing(inst, AS_OF).collect()]
    assert running == sorted(running) and len(running) > 1
    for digest in (digests.age_digest(inst, AS_OF, min_days=1), digests.expiry_digest(inst, AS_OF)):
        keys = [(r.owner, r.build) for r in digest.collect()]
        assert keys == sorted(keys) and len(keys) > 1
    boxes = costs.cost_rows(inst, AS_OF)
    by_age = [(-r.age_days, [-ord(c) for c in r.short_name], r.instance_id) for r in costs.cost_by_box(boxes).collect()]
    assert by_age == sorted(by_age)
    by_name = [(r.short_name, r.instance_id) for r in costs.cost_by_box(boxes, by="name").collect()]
    assert by_name == sorted(by_name) and len(by_name) == 24
    owners = [r.owner for r in costs.cost_by_owner(boxes).collect()]
    assert owners == sorted(owners)


def test_digest_headings_and_links(spark):
    inst = make_instances(spark, [{"instance_id": "i-1", "launch": ago(3), "tags": t(
        build="a", launched_by_email="u@e", launched_at=iso(ago(3)), terminate_after=iso(ago(-2)))}])
    one = digests.age_digest(inst, AS_OF, min_days=1, report_url="https://r.test").first()
    assert one.heading == "Here's a list of your instances that have been running for 1 day or more:"
    assert one.link == "https://r.test"
    assert " 2 days or more:" in digests.age_digest(inst, AS_OF).first().heading
    soon = digests.expiry_digest(inst, AS_OF, extend_url="https://r.test/more?b=").first()
    assert soon.heading.endswith("terminated soon:") and soon.link == "https://r.test/more?b=a"


def test_overwritten_brokers_are_seen_and_nothing_is_cached(spark, tmp_path):
    import json

    from opsdeck.sources.inventory import read_brokers
    inst = make_instances(spark, [{"instance_id": "i-1", "tags": t(build="a")}])

    def rabbit(broker):
        (tmp_path / "brokers.json").write_text(json.dumps({"BrokerSummaries": [{"BrokerId": broker, "BrokerName": "a-rabbit-dev"}]}))
        return listings.fleet_listing(inst, read_brokers(spark, str(tmp_path)), AS_OF).first().rabbit

    assert "old" in rabbit("old") and "new" in rabbit("new")
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
