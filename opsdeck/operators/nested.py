"""Nested inventory documents <-> flat instance rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.functions.tags import entries_to_map
from opsdeck.functions.timefns import iso_z_millis, parse_iso

INSTANCE_COLUMNS = ("res_pos", "inst_pos", "instance_id", "launch_time", "private_ip", "state", "tags")


def flatten_instances(doc: DataFrame) -> DataFrame:
    """``Reservations[].Instances[]`` -> one row per instance, document order kept as positions.

    Other top-level columns of ``doc`` (a page number, a snapshot id) are carried along, so
    several documents can be flattened together and ordered by (page, res_pos, inst_pos).
    Tags become a map in which a repeated key keeps its last value; missing tags give an
    empty map.
    """
    carry = [c for c in doc.columns if c != "Reservations"]
    reservations = doc.select(*carry, F.posexplode("Reservations").alias("res_pos", "_res"))
    instances = reservations.select(*carry, "res_pos",
                                    F.posexplode("_res.Instances").alias("inst_pos", "_inst"))
    inst = F.col("_inst")
    return instances.select(
        *carry,
        "res_pos",
        "inst_pos",
        inst["InstanceId"].alias("instance_id"),
        parse_iso(inst["LaunchTime"]).alias("launch_time"),
        inst["PrivateIpAddress"].alias("private_ip"),
        inst["State"]["Name"].alias("state"),
        entries_to_map(inst["Tags"]).alias("tags"),
    )


def page_of(res_pos: Column, page_size: int) -> Column:
    """The page of a reservation by its global position."""
    return F.floor(res_pos / page_size).cast("bigint")


def nest_instances(instances: DataFrame, page_size: int = 10) -> DataFrame:
    """Flat rows -> document pages ``page, Reservations``: the inverse of ``flatten_instances``.

    ``res_pos`` is global here; page ``p`` holds reservations ``p*page_size ..`` in order, so
    flattening the pages yields the same order as (res_pos, inst_pos). Group sizes are
    bounded by ``page_size`` reservations and the instances of one reservation. Tags are
    taken from a ``Tags`` entry array when present (it may repeat keys), else from ``tags``.
    Rows that come partitioned by ``page_of`` are not shuffled again.
    """
    if "Tags" in instances.columns:
        tag_entries = F.col("Tags")
    else:
        tag_entries = F.transform(F.map_entries("tags"),
                                  lambda e: F.struct(e["key"].alias("Key"), e["value"].alias("Value")))
    inst = F.struct(
        F.col("instance_id").alias("InstanceId"),
        iso_z_millis(F.col("launch_time")).alias("LaunchTime"),
        F.col("private_ip").alias("PrivateIpAddress"),
        F.struct(F.col("state").alias("Name")).alias("State"),
        tag_entries.alias("Tags"),
    )
    page = page_of(F.col("res_pos"), page_size).alias("page")
    per_res = instances.groupBy(page, "res_pos").agg(
        F.array_sort(F.collect_list(F.struct(F.col("inst_pos").alias("p"), inst.alias("i")))).alias("_insts"))
    reservation = F.struct(F.transform("_insts", lambda x: x["i"]).alias("Instances"))
    per_page = per_res.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct(F.col("res_pos").alias("p"), reservation.alias("r")))).alias("_res"))
    return per_page.select("page", F.transform("_res", lambda x: x["r"]).alias("Reservations"))
