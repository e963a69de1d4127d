"""Hand-built instances for the tests of the inventory reports."""

from __future__ import annotations

import datetime as dt

AS_OF = dt.datetime(2001, 7, 31, 12, 0, 0)
INSTANCE_SCHEMA = ("res_pos int, inst_pos int, instance_id string, launch_time timestamp_ntz, "
                   "private_ip string, state string, tags map<string,string>")


def make_instances(spark, rows):
    """rows: dicts with instance_id, state, launch (datetime), tags (dict); positions follow list order."""
    data = []
    for i, r in enumerate(rows):
        data.append((r.get("res_pos", i), r.get("inst_pos", 0), r["instance_id"], r.get("launch", AS_OF),
                     r.get("ip", "10.0.0.1"), r.get("state", "running"), r.get("tags", {})))
    return spark.createDataFrame(data, INSTANCE_SCHEMA)


def ago(days=0, hours=0):
    return AS_OF - dt.timedelta(days=days, hours=hours)


def iso(ts: dt.datetime, millis: bool = True) -> str:
    return ts.strftime("%Y-%m-%dT%H:%M:%S") + (".000Z" if millis else "Z")
