"""Plans of lifecycle actions (rows of intended actions; nothing calls the cloud)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdeck.constants import ACTION_START, ACTION_STOP, ACTION_TERMINATE
from opsdeck.functions.tags import tag, tag_exists, tag_truthy
from opsdeck.functions.timefns import add_hours, as_of_lit, elapsed_days, iso_z, parse_iso
from opsdeck.operators.collapse import first_by
from opsdeck.plans.fleet import in_state, order_columns, test_fleet


def _expiring(instances: DataFrame) -> DataFrame:
    return test_fleet(instances).filter(tag_exists("terminate_after"))


def nightly_plan(instances: DataFrame, as_of) -> DataFrame:
    """Running test instances with an expiry tag -> ``terminate`` when expired strictly
    before ``as_of``, otherwise ``stop`` (also for an empty or unreadable expiry).

    Columns: instance_id, name, expires_days (null without a readable expiry), action.
    """
    now = as_of_lit(as_of)
    expires = F.when(tag_truthy("terminate_after"), parse_iso(tag("terminate_after")))
    action = F.when(F.coalesce(expires < now, F.lit(False)), F.lit(ACTION_TERMINATE)).otherwise(F.lit(ACTION_STOP))
    return _expiring(instances).filter(in_state("running")).select(
        "instance_id", tag("Name").alias("name"), elapsed_days(now, expires).alias("expires_days"),
        action.alias("action"))


def morning_plan(instances: DataFrame) -> DataFrame:
    """Stopped test instances with an expiry tag -> ``start``."""
    return _expiring(instances).filter(in_state("stopped")).select(
        "instance_id", tag("Name").alias("name"), F.lit(ACTION_START).alias("action"))


def extend_lifetime(instances: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested build, the first listed test instance of that build with an
    expiry tag gets its expiry moved later by the hours of all its requests.

    Each request moves the expiry that the one before left, so repeated requests of a build add
    up. Columns: build, n_requests, hours (their sum), instance_id, name, old_terminate_after,
    new_terminate_after and new_tag_value (the new expiry as ``yyyy-MM-ddTHH:mm:ssZ``).
    Requests matching no instance produce no row. Instances and requests are reduced to one row
    per build (map-side first) before they meet.
    """
    order = order_columns(instances)
    candidates = _expiring(instances).select(
        tag("build").alias("build"), *order, "instance_id", tag("Name").alias("name"),
        tag("terminate_after").alias("terminate_after"))
    asked = requests.groupBy("build").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("hours").alias("hours"))
    first = first_by(candidates, ["build"], order).join(asked, "build")
    old = parse_iso(F.col("terminate_after"))
    new = add_hours(old, F.col("hours"))
    return first.select("build", "n_requests", "hours", "instance_id", "name", old.alias("old_terminate_after"),
                        new.alias("new_terminate_after"), iso_z(new).alias("new_tag_value"))
