"""Registered queries: one per operator/report, each reading the given test tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column names match
the oracle SQL of the same key in ``opsdeck.oracle``.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdeck.functions.tags import present_and_not, tag, tag_equals, tag_exists, tag_truthy
from opsdeck.functions.text import comma_list
from opsdeck.functions.urls import default_url_rules
from opsdeck.operators.access_log import parse_access_log
from opsdeck.operators.nested import flatten_instances
from opsdeck.plans import costs, digests, lifecycle, listings, traffic
from opsdeck.plans.fleet import is_state
from opsdeck.session import ensure_checkpoint_dir
from opsdeck.sources import fixtures as fx
from opsdeck.sources.logs import read_access_log
from opsdeck.streaming import log_stream

RULES = default_url_rules(fx.ID_PREFIX)
Query = Callable[[SparkSession, str], DataFrame]


def _log_files(spark, sf_dir):
    """The derived proxy lines as plain log files in a folder (the production input)."""
    return read_access_log(spark, fx.access_log_folder(spark, sf_dir), glob="*.txt")


def access_log_parsed(spark, sf_dir):
    return parse_access_log(_log_files(spark, sf_dir), fx.LOG_MARKER)


def url_normalized(spark, sf_dir):
    pages = fx.load(spark, sf_dir, "pages").select("url")
    logged = access_log_parsed(spark, sf_dir).select("url")
    return traffic.normalized_urls(pages.union(logged).distinct(), RULES)


def endpoint_stats(spark, sf_dir):
    return traffic.endpoint_stats(fx.access_log_lines(spark, sf_dir), fx.LOG_MARKER, RULES)


def endpoint_stats_files(spark, sf_dir):
    """R1 read the production way: plain log files in a folder through ``read_access_log``."""
    return traffic.endpoint_stats(_log_files(spark, sf_dir), fx.LOG_MARKER, RULES)


def endpoint_stats_all(spark, sf_dir):
    return traffic.endpoint_stats(_log_files(spark, sf_dir), fx.LOG_MARKER, RULES, limit=None)


def endpoint_stats_streamed(spark, sf_dir):
    """R1 with Structured Streaming ingestion: the derived log files are parsed by a stream
    (available-now trigger) into a parquet table, then aggregated."""
    folder = fx.access_log_folder(spark, sf_dir)
    # one table per landed folder: a later call goes on from its checkpoint and finds nothing new
    run = os.path.basename(folder.rstrip("/"))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/opsdeck-stream/{run}"
    requests = log_stream.requests_stream(spark, folder, fx.LOG_MARKER, RULES, glob="*.txt")
    query = log_stream.start_ingest(requests, f"{base}/requests", available_now=True,
                                    name=f"access_log_ingest_{run}")
    query.awaitTermination()
    return log_stream.endpoint_stats_ingested(spark, f"{base}/requests")


def instances_flattened(spark, sf_dir):
    flat = flatten_instances(fx.inventory_docs(spark, sf_dir))
    tag_cols = [tag(k).alias(k) for k in ("role", "build", "hostname", "launched_by_name",
                                          "launched_by_email", "no_age_alert")]
    return flat.select("page", "res_pos", "inst_pos", "instance_id", "launch_time", "private_ip", "state",
                       *tag_cols, tag("Name").alias("name"), tag("launched_at").alias("launched_at"),
                       tag("terminate_after").alias("terminate_after"))


def tag_filters(spark, sf_dir):
    inst = fx.instances(spark, sf_dir)
    return inst.select(
        "instance_id",
        tag_equals("role", "test").alias("is_test"),
        tag_exists("terminate_after").alias("has_terminate_after"),
        tag_truthy("terminate_after").alias("terminate_after_truthy"),
        tag_truthy("build").alias("build_truthy"),
        tag_truthy("hostname").alias("hostname_truthy"),
        present_and_not(tag("launched_by_email"), fx.IGNORE_OWNER).alias("owner_email_ok"),
        is_state("running").alias("running"),
        tag_exists("no_age_alert").alias("no_age_alert_defined"),
    )


def build_last_wins(spark, sf_dir):
    last = listings.build_last_wins(fx.instances(spark, sf_dir), fx.EXCLUDED_BUILDS)
    position = (F.col("page") * 10 + F.col("res_pos")).cast("int")  # pages hold 10 reservations
    return last.select("build", "instance_id", position.alias("res_pos"), "inst_pos", "state",
                       F.col("tags")["hostname"].alias("hostname"),
                       F.col("tags")["launched_by_name"].alias("launched_by_name"))


def build_last_wins_fieldwise(spark, sf_dir):
    return listings.build_last_wins_fieldwise(fx.instances(spark, sf_dir), fx.AS_OF)


def broker_lookup(spark, sf_dir):
    return listings.broker_lookup(fx.instances(spark, sf_dir), fx.brokers(spark, sf_dir),
                                  exclude_builds=fx.EXCLUDED_BUILDS)


def hostname_fallback(spark, sf_dir):
    return listings.hostname_fallback(fx.instances(spark, sf_dir))


def fleet_listing(spark, sf_dir):
    return listings.fleet_listing(fx.instances(spark, sf_dir), fx.brokers(spark, sf_dir), fx.AS_OF,
                                  exclude_builds=fx.EXCLUDED_BUILDS)


def running_listing(spark, sf_dir):
    return listings.running_listing(fx.instances(spark, sf_dir), fx.AS_OF)


def listing_counts(spark, sf_dir):
    return listings.listing_counts(fx.instances(spark, sf_dir), exclude_builds=fx.EXCLUDED_BUILDS)


def age_digest(spark, sf_dir):
    return digests.age_digest(fx.instances(spark, sf_dir), fx.AS_OF, ignore_owner=fx.IGNORE_OWNER)


def expiry_digest(spark, sf_dir):
    return digests.expiry_digest(fx.instances(spark, sf_dir), fx.AS_OF, ignore_owner=fx.IGNORE_OWNER)


#: Items of a part in the registered bodies and lists: few, so that the test tables make several parts.
PART = 7


def age_digest_bodies(spark, sf_dir):
    return digests.age_bodies(age_digest(spark, sf_dir), PART)


def expiry_digest_bodies(spark, sf_dir):
    return digests.expiry_bodies(expiry_digest(spark, sf_dir), PART)


def fleet_listing_order(spark, sf_dir):
    return listings.fleet_listing(fx.instances(spark, sf_dir), fx.brokers(spark, sf_dir), fx.AS_OF,
                                  exclude_builds=fx.EXCLUDED_BUILDS, numbered=True).select("position", "build", "running")


def running_listing_order(spark, sf_dir):
    return listings.running_listing(fx.instances(spark, sf_dir), fx.AS_OF, numbered=True).select("position", "build", "owner")


def cost_orders(spark, sf_dir):
    """Boxes by name, boxes by age and owners by name, with their positions."""
    rows = _costs(spark, sf_dir)
    lists = (("name", costs.cost_by_box(rows, by="name", numbered=True), F.col("instance_id")),
             ("age", costs.cost_by_box(rows, by="age", numbered=True), F.col("instance_id")),
             ("owner", costs.cost_by_owner(rows, numbered=True), F.col("owner")))
    return reduce(DataFrame.unionAll, [r.select(F.lit(name).alias("list"), "position", key.alias("entry"), "item_text") for name, r, key in lists])


def cost_message(spark, sf_dir):
    return costs.cost_message(_costs(spark, sf_dir), items_per_part=PART)


def _costs(spark, sf_dir):
    return costs.cost_rows(fx.instances(spark, sf_dir), fx.AS_OF)


def cost_totals(spark, sf_dir):
    return costs.cost_totals(_costs(spark, sf_dir))


def cost_by_box(spark, sf_dir):
    return costs.cost_by_box(_costs(spark, sf_dir))


def cost_by_box_name(spark, sf_dir):
    return costs.cost_by_box(_costs(spark, sf_dir), by="name")


def name_lists(spark, sf_dir):
    """Part names, their words as a comma list, and that list as it is shown."""
    words = F.concat_ws(",", F.split(F.col("p_name"), " "))
    listed = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 11 == 1, F.lit("")).otherwise(words)
    parts = fx.load(spark, sf_dir, "part")
    return parts.select("p_partkey", listed.alias("listed")).select("p_partkey", comma_list(F.col("listed")).alias("shown"))


def cost_by_owner(spark, sf_dir):
    return costs.cost_by_owner(_costs(spark, sf_dir))


def nightly_plan(spark, sf_dir):
    return lifecycle.nightly_plan(fx.instances(spark, sf_dir), fx.AS_OF)


def morning_plan(spark, sf_dir):
    return lifecycle.morning_plan(fx.instances(spark, sf_dir))


def extend_lifetime(spark, sf_dir):
    return lifecycle.extend_lifetime(fx.instances(spark, sf_dir), fx.extension_requests(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "access_log_parsed": access_log_parsed,                  # A1 B1-B3 G1
    "url_normalized": url_normalized,                        # G2 G3
    "endpoint_stats": endpoint_stats,                        # R1: E1-E3 F1 (DataFrame input)
    "endpoint_stats_files": endpoint_stats_files,            # R1 from log files (A1)
    "endpoint_stats_all": endpoint_stats_all,                # E1-E3 without the top-k cut
    "endpoint_stats_streamed": endpoint_stats_streamed,      # R1 through streaming ingestion
    "instances_flattened": instances_flattened,              # A2 C1 C2
    "tag_filters": tag_filters,                              # B4-B7 B9 G15
    "build_last_wins": build_last_wins,                      # E4 B8
    "build_last_wins_fieldwise": build_last_wins_fieldwise,  # E4f I2
    "broker_lookup": broker_lookup,                          # A3 J1 G5
    "hostname_fallback": hostname_fallback,                  # C3 C4 G7
    "fleet_listing": fleet_listing,                          # R2: C3 C5 C6 H1 H4 I1 G8 F2
    "running_listing": running_listing,                      # R3: C4 C5 H3 H5 H9 I2 I3 F3
    "listing_counts": listing_counts,                        # E8
    "age_digest": age_digest,                                # R4: B10 E4o E7 G9
    "expiry_digest": expiry_digest,                          # R5: B11 H6 H8 G10 I6
    "age_digest_bodies": age_digest_bodies,                  # R4 body_text, in parts
    "expiry_digest_bodies": expiry_digest_bodies,            # R5 body_text, in parts
    "fleet_listing_order": fleet_listing_order,              # F2
    "running_listing_order": running_listing_order,          # F3
    "cost_orders": cost_orders,                              # F4 F5 F6
    "cost_message": cost_message,                            # G11 G12
    "cost_totals": cost_totals,                              # R6a: C7 E5 I4 I5
    "cost_by_box": cost_by_box,                              # R6b: G6 G11 F5
    "cost_by_box_name": cost_by_box_name,                    # F4
    "name_lists": name_lists,                                # G13
    "cost_by_owner": cost_by_owner,                          # R6c: E6 G11 F6
    "nightly_plan": nightly_plan,                            # R7: B5 B7 B13 H2 H6
    "morning_plan": morning_plan,                            # R8
    "extend_lifetime": extend_lifetime,                      # R9: J2 B12 F7 H7
}
