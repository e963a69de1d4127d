"""R2 fleet listing (all states, calendar age, broker link) and R3 running listing
(running only, elapsed age, host-name fallback, field-wise last wins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.constants import (BROKER_CONSOLE_TEMPLATE, BROKER_NAME_SEPARATOR, DEFAULT_REGION, FLEET_DANGER_DAYS,
                               FLEET_EXCLUDED_BUILDS, FLEET_WARN_DAYS, PORTAINER_PORT,
                               RUNNING_DANGER_DAYS, RUNNING_EXPIRES_TEXT, RUNNING_OVERDUE_DAYS,
                               RUNNING_WARN_DAYS, STATUS_RUNNING, STATUS_STOPPED)
from opsdeck.functions.tags import tag, tag_exists, tag_truthy, truthy
from opsdeck.functions.text import age_label, owner_or_unknown, severity
from opsdeck.functions.timefns import (as_of_lit, calendar_days, created_display, elapsed_days,
                                       parse_iso)
from opsdeck.operators.collapse import last_by
from opsdeck.operators.positions import with_positions
from opsdeck.plans.fleet import in_state, is_state, order_columns, test_fleet


def _links(host: Column, site: str, admin_site: str | None = None) -> list[Column]:
    cols = [
        F.concat(F.lit(f"https://{site}."), host).alias("website"),
        F.concat(F.lit("http://"), host, F.lit(f":{PORTAINER_PORT}")).alias("portainer"),
    ]
    if admin_site is not None:
        cols.append(F.concat(F.lit(f"http://{admin_site}."), host).alias("admin"))
    return cols


def broker_links(brokers: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """``build, rabbit``: console URL of the last-listed broker of each build.

    A broker's build is its name up to the separator (the whole name when absent).
    """
    order = [c for c in ("page", "pos") if c in brokers.columns]
    keyed = brokers.select(F.substring_index("broker_name", BROKER_NAME_SEPARATOR, 1).alias("build"),
                           *order, "broker_id")
    last = last_by(keyed, ["build"], order)
    before, after = BROKER_CONSOLE_TEMPLATE.split("{broker_id}")
    url = F.concat(F.lit(before), F.col("broker_id"), F.lit(after.format(region=region)))
    return last.select("build", url.alias("rabbit"))


def attach_brokers(listing: DataFrame, brokers: DataFrame, region: str = DEFAULT_REGION) -> DataFrame:
    """Left lookup of the broker console per build; ``''`` when a build has no broker.

    Both sides have one row per build, so no key is hot; the planner broadcasts the links when
    their bytes are few.
    """
    joined = listing.join(broker_links(brokers, region), "build", "left")
    return joined.withColumn("rabbit", F.coalesce(F.col("rabbit"), F.lit("")))


def fleet_builds(instances: DataFrame, exclude_builds: Sequence[str] = FLEET_EXCLUDED_BUILDS) -> DataFrame:
    """Test instances with a build tag outside ``exclude_builds``."""
    build = tag("build")
    return test_fleet(instances).filter(build.isNotNull() & ~build.isin(*exclude_builds))


def build_last_wins(instances: DataFrame, exclude_builds: Sequence[str] = FLEET_EXCLUDED_BUILDS) -> DataFrame:
    """One row per build: the whole last-listed instance of it."""
    order = order_columns(instances)
    rows = fleet_builds(instances, exclude_builds).select(
        tag("build").alias("build"), *order, "instance_id", "launch_time", "private_ip", "state", "tags")
    return last_by(rows, ["build"], order)


def fleet_listing(instances: DataFrame, brokers: DataFrame, as_of, *,
                  warn_days: int = FLEET_WARN_DAYS, danger_days: int = FLEET_DANGER_DAYS,
                  exclude_builds: Sequence[str] = FLEET_EXCLUDED_BUILDS, site: str = "www",
                  admin_site: str = "admin", region: str = DEFAULT_REGION, numbered: bool = False) -> DataFrame:
    """R2: one row per build (last instance wins), all states, running ones first; with ``numbered``
    as a ``position`` column (see ``operators.positions``) instead of sorted.

    Age is in calendar days from the ``launched_at`` tag to ``as_of``; severity uses strict
    thresholds. Columns: build, owner, hostname, website, portainer, admin, rabbit,
    launched_at, age_days, age_label, severity, running, status_label, status_color.
    """
    now = as_of_lit(as_of)
    order = order_columns(instances)
    # Only the fields the listing needs travel through the collapse.
    rows = fleet_builds(instances, exclude_builds).select(
        tag("build").alias("build"), *order, "state", tag("hostname").alias("host"),
        tag("launched_by_name").alias("owner_name"), tag("launched_at").alias("launched_at_tag"))
    last = last_by(rows, ["build"], order)
    host = F.col("host")
    launched = parse_iso(F.col("launched_at_tag"))
    age = calendar_days(launched, now).cast("bigint")
    listing = last.select(
        "build",
        owner_or_unknown(F.col("owner_name"), script_truth=False).alias("owner"),
        host.alias("hostname"),
        *_links(host, site, admin_site),
        launched.alias("launched_at"),
        age.alias("age_days"),
        age_label(age).alias("age_label"),
        severity(age, warn_days, danger_days, strict=True).alias("severity"),
        is_state("running").alias("running"),
    )
    listing = attach_brokers(listing, brokers, region)
    running = F.col("running")
    listing = listing.select(
        "*",
        F.when(running, F.lit(STATUS_RUNNING[0])).otherwise(F.lit(STATUS_STOPPED[0])).alias("status_label"),
        F.when(running, F.lit(STATUS_RUNNING[1])).otherwise(F.lit(STATUS_STOPPED[1])).alias("status_color"))
    cols = ["build", "owner", "hostname", "website", "portainer", "admin", "rabbit",
            "launched_at", "age_days", "age_label", "severity", "running", "status_label", "status_color"]
    order = [F.desc("running"), F.lower("build"), "build"]
    return with_positions(listing.select(*cols), order) if numbered else listing.select(*cols).orderBy(*order)


def hostname_fallback(instances: DataFrame, *, site: str = "www", domain: str = "example.test") -> DataFrame:
    """Per running test instance with a build: displayed host name and links (C4).

    The ``hostname`` tag when set, else the build name with ``_`` -> ``-`` plus ``domain``.
    Only the displayed name is lower-cased.
    """
    rows = _running_with_build(instances)
    host = _link_host(domain)
    return rows.select("instance_id", tag("build").alias("build"), F.lower(host).alias("hostname"),
                       *_links(host, site))


def _running_with_build(instances: DataFrame) -> DataFrame:
    return test_fleet(instances).filter(tag_truthy("build") & in_state("running"))


def _link_host(domain: str) -> Column:
    guessed = F.concat(F.replace(tag("build"), F.lit("_"), F.lit("-")), F.lit("." + domain))
    return F.when(truthy(tag("hostname")), tag("hostname")).otherwise(guessed)


def running_rows(instances: DataFrame, as_of, *, warn_days: int = RUNNING_WARN_DAYS,
                 danger_days: int = RUNNING_DANGER_DAYS, domain: str = "example.test") -> DataFrame:
    """Per running test instance with a build: the inputs of a running-listing row.

    Launch time is the ``launched_at`` tag when set, else the API launch time; age is whole
    elapsed days. ``severity`` is null (not written) when ``no_age_alert`` is present.
    Texts are rendered after the collapse (``render_running``), so the shuffle carries only
    these inputs.
    """
    now = as_of_lit(as_of)
    launched = F.when(tag_truthy("launched_at"), parse_iso(tag("launched_at"))).otherwise(F.col("launch_time"))
    age = elapsed_days(launched, now)
    sev = F.when(tag_exists("no_age_alert"), F.lit(None).cast("string")) \
        .otherwise(severity(age, warn_days, danger_days, strict=False))
    return _running_with_build(instances).select(
        tag("build").alias("build"),
        *order_columns(instances),
        "instance_id",
        owner_or_unknown(tag("launched_by_name"), script_truth=True).alias("owner"),
        _link_host(domain).alias("link_host"),
        launched.alias("launched"),
        age.alias("age_days"),
        sev.alias("severity"),
    )


def render_running(rows: DataFrame, *, overdue_days: int = RUNNING_OVERDUE_DAYS, site: str = "www") -> DataFrame:
    """Running-listing columns from collapsed ``running_rows``. Only the displayed host name
    is lower-cased; links keep the tag's case."""
    host, age = F.col("link_host"), F.col("age_days")
    return rows.select(
        "build", "owner", F.lower(host).alias("hostname"), *_links(host, site),
        F.lit(RUNNING_EXPIRES_TEXT).alias("expires"),
        created_display(F.col("launched")).alias("created"),
        "age_days", age_label(age).alias("age_label"), (age >= overdue_days).alias("overdue"),
        "severity",
    )


def running_listing(instances: DataFrame, as_of, *, warn_days: int = RUNNING_WARN_DAYS,
                    danger_days: int = RUNNING_DANGER_DAYS, overdue_days: int = RUNNING_OVERDUE_DAYS,
                    site: str = "www", domain: str = "example.test", numbered: bool = False) -> DataFrame:
    """One row per running build, sorted by build (``numbered``: with its ``position``). Every field comes from the last
    instance of the build except ``severity``, which keeps the last value written (an
    instance with ``no_age_alert`` does not overwrite it).

    Columns: build, owner, hostname, website, portainer, expires, created, age_days,
    age_label, overdue, severity.
    """
    rows = running_rows(instances, as_of, warn_days=warn_days, danger_days=danger_days, domain=domain)
    last = last_by(rows, ["build"], order_columns(instances), keep_last_set=["severity"])
    listing = render_running(last, overdue_days=overdue_days, site=site)
    return with_positions(listing, ["build"]) if numbered else listing.orderBy("build")


def build_last_wins_fieldwise(instances: DataFrame, as_of, **kwargs) -> DataFrame:
    """E4f on its own: ``build, instance_id, age_days, severity`` after the field-wise collapse."""
    order = order_columns(instances)
    rows = running_rows(instances, as_of, **kwargs).select("build", *order, "instance_id", "age_days", "severity")
    last = last_by(rows, ["build"], order, keep_last_set=["severity"])
    return last.select("build", "instance_id", "age_days", "severity")


def broker_lookup(instances: DataFrame, brokers: DataFrame, *,
                  exclude_builds: Sequence[str] = FLEET_EXCLUDED_BUILDS, region: str = DEFAULT_REGION) -> DataFrame:
    """J1 on its own: ``build, rabbit`` for every listed build (``''`` without a broker)."""
    builds = fleet_builds(instances, exclude_builds).select(tag("build").alias("build")).distinct()
    return attach_brokers(builds, brokers, region)


def listing_counts(instances: DataFrame, exclude_builds: Sequence[str] = FLEET_EXCLUDED_BUILDS) -> DataFrame:
    """Number of builds in the fleet listing (R2) and the running listing (R3), as one row.

    Each listing has exactly one row per qualifying build, so the sizes come from one scan:
    a per-build aggregate of two membership flags (partial + final, so a hot build ships one
    row per task), then a global sum. No listing is built, and no row is duplicated as the
    Expand behind two conditional distinct counts would.
    """
    build = tag("build")
    in_fleet = ~build.isin(*exclude_builds)
    in_running = tag_truthy("build") & in_state("running")
    per_build = test_fleet(instances).filter(build.isNotNull()).groupBy(build.alias("build")).agg(
        F.max(in_fleet.cast("int")).alias("f"), F.max(F.coalesce(in_running, F.lit(False)).cast("int")).alias("r"))
    return per_build.agg(F.coalesce(F.sum("f"), F.lit(0)).cast("bigint").alias("n_fleet_builds"),
                         F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("n_running_builds"))
