"""R4 long-running digest and R5 soon-to-expire digest, one row per (owner, build).

A digest is kept in long form: each row is one item of one owner's message and carries
the owner's header (item count, subject), so an owner with millions of builds is still spread
over many tasks. ``age_bodies`` and ``expiry_bodies`` render the message bodies from such rows in
parts of a bounded number of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.constants import (AGE_BODY_CLOSE, AGE_BODY_ITEM, AGE_BODY_OPEN, AGE_DIGEST_HEADING_FORMAT, AGE_DIGEST_ITEM_FORMAT, AGE_DIGEST_MIN_DAYS, AGE_ZERO_TEXT,
                               DIGEST_SUBJECT_LEAD, EXPIRY_BODY_ITEM, EXPIRY_BODY_OPEN, EXPIRY_DIGEST_HEADING, EXPIRY_DIGEST_ITEM_FORMAT,
                               EXPIRY_DIGEST_WITHIN_DAYS)
from opsdeck.functions.tags import present_and_not, tag, tag_truthy
from opsdeck.functions.text import plural
from opsdeck.functions.timefns import as_of_lit, elapsed_days, expiry_phrase, parse_iso
from opsdeck.operators.collapse import last_by
from opsdeck.operators.joins import salted_join
from opsdeck.operators.positions import joined_in_parts, with_group_positions
from opsdeck.plans.fleet import in_state, order_columns, test_fleet

ITEMS_PER_PART = 500
DEFAULT_SUBJECT_PREFIX = "[EC2 report] "
DEFAULT_REPORT_URL = "https://reports.example.test/instances"
DEFAULT_EXTEND_URL = "https://reports.example.test/extend?instance="


def _owned_running(instances: DataFrame, ignore_owner: str) -> DataFrame:
    email = tag("launched_by_email")
    return test_fleet(instances).filter(tag_truthy("build") & in_state("running")
                                        & present_and_not(email, ignore_owner))


def with_owner_header(items: DataFrame, subject_prefix: str = DEFAULT_SUBJECT_PREFIX,
                      count_column: str | None = None) -> DataFrame:
    """Adds ``n_instances`` (items of the owner) and ``subject`` to every item row.

    The per-owner count is a partial+final aggregate joined back on owner and a salt of the
    build, so an owner with a third of all items is spread over many tasks (an aggregated side
    is one that AQE does not split). ``count_column`` names a
    column that is never null in ``items`` (guaranteed by an earlier filter): counting it
    equals counting rows, and keeps the count branch reading the same collapse as the item
    rows, so both share one shuffle and the inventory is scanned once.
    """
    counted = F.count(F.col(count_column)) if count_column else F.count(F.lit(1))
    counts = items.groupBy("owner").agg(counted.alias("n_instances"))
    subject = F.concat(F.lit(subject_prefix + DIGEST_SUBJECT_LEAD), plural(F.col("n_instances"), "running instance"))
    return salted_join(items, counts, "owner", "build").withColumn("subject", subject)


def age_digest(instances: DataFrame, as_of, *, min_days: int = AGE_DIGEST_MIN_DAYS,
               ignore_owner: str = "ops@example.test",
               subject_prefix: str = DEFAULT_SUBJECT_PREFIX,
               report_url: str = DEFAULT_REPORT_URL) -> DataFrame:
    """Running test instances at least ``min_days`` old (elapsed days from the API launch
    time), per owner e-mail; a build listed twice keeps its last qualifying instance.

    Columns: owner, build, age_days, item_text, heading, link, n_instances, subject; sorted by
    owner, build. ``heading`` and ``link`` (to the report) are the same for every row.
    """
    now = as_of_lit(as_of)
    order = order_columns(instances)
    age = elapsed_days(F.col("launch_time"), now)
    rows = _owned_running(instances, ignore_owner).select(
        tag("launched_by_email").alias("owner"), tag("build").alias("build"), *order, age.alias("age_days"))
    rows = rows.filter(F.col("age_days") >= min_days)
    last = last_by(rows, ["owner", "build"], order)
    item = F.format_string(AGE_DIGEST_ITEM_FORMAT, F.col("build"), plural(F.col("age_days"), "day"))
    days = f"{min_days} day" + ("" if min_days == 1 else "s")
    items = last.select("owner", "build", "age_days", item.alias("item_text"),
                        F.lit(AGE_DIGEST_HEADING_FORMAT % days).alias("heading"), F.lit(report_url).alias("link"))
    # age_days >= min_days above: never null
    return with_owner_header(items, subject_prefix, count_column="age_days").orderBy("owner", "build")


def _bodies(items: DataFrame, opened: Column, item: Column, closed: Column, items_per_part: int) -> DataFrame:
    """owner, part, n_parts, n_items, n_instances, subject, body_text: the first part begins with ``opened``,
    the last one ends with ``closed``, so an owner's parts, one after another, are the whole body.

    ``opened`` and ``closed`` are the same for all items of an owner. Places within an owner come from
    the global order (``operators.positions``); a group holds at most ``items_per_part`` items.
    """
    needed = items.select("owner", "build", "n_instances", "subject", item.alias("_item"), opened.alias("_open"), closed.alias("_close"))
    placed = with_group_positions(needed, "owner", ["build"], "build")
    keys = ["owner", "n_instances", "subject", "_open", "_close"]
    parts = joined_in_parts(placed, F.col("_item"), "position", items_per_part, "", keys)
    n_parts = F.ceil(F.col("n_instances") / F.lit(items_per_part)).cast("bigint")
    body = F.concat(F.when(F.col("part") == 1, F.col("_open")).otherwise(""), F.col("text"),
                    F.when(F.col("part") == n_parts, F.col("_close")).otherwise(""))
    return parts.select("owner", "part", n_parts.alias("n_parts"), "n_items", "n_instances", "subject", body.alias("body_text"))


def age_bodies(digest: DataFrame, items_per_part: int = ITEMS_PER_PART) -> DataFrame:
    """R4's message bodies (HTML) from the rows of ``age_digest``, in parts of bounded size."""
    item = F.format_string(AGE_BODY_ITEM, F.col("build"), plural(F.col("age_days"), "day"))
    return _bodies(digest, F.format_string(AGE_BODY_OPEN, F.col("heading")), item, F.format_string(AGE_BODY_CLOSE, F.col("link")), items_per_part)


def expiry_bodies(digest: DataFrame, items_per_part: int = ITEMS_PER_PART) -> DataFrame:
    """R5's message bodies (HTML) from the rows of ``expiry_digest``; an item whose age is unknown is left
    out of the text, as its line can't be rendered."""
    age = _age_text(F.col("age_days"))
    item = F.format_string(EXPIRY_BODY_ITEM, F.col("build"), age, F.col("expires_on"), F.col("link"))
    item = F.when(age.isNotNull() & F.col("expires_on").isNotNull(), item)
    return _bodies(digest, F.format_string(EXPIRY_BODY_OPEN, F.col("heading")), item, F.lit(""), items_per_part)


def _age_text(age: Column) -> Column:
    return F.when(age == 0, F.lit(AGE_ZERO_TEXT)).otherwise(plural(age, "day"))


def expiry_digest(instances: DataFrame, as_of, *, within_days: int = EXPIRY_DIGEST_WITHIN_DAYS,
                  ignore_owner: str = "ops@example.test",
                  subject_prefix: str = DEFAULT_SUBJECT_PREFIX,
                  extend_url: str = DEFAULT_EXTEND_URL) -> DataFrame:
    """Running test instances with an expiry tag that expire within ``within_days`` whole
    days (already expired ones included), per owner e-mail.

    Age runs from the ``launched_at`` tag to ``as_of`` (positive for past launches);
    ``expires_days`` is whole days from ``as_of`` to the expiry, truncated toward zero.
    Columns: owner, build, age_days, expires_days, expires_on, item_text, heading, link (to
    extend the item's build), n_instances, subject.
    """
    now = as_of_lit(as_of)
    order = order_columns(instances)
    expires = parse_iso(tag("terminate_after"))
    rows = _owned_running(instances, ignore_owner).filter(tag_truthy("terminate_after")).select(
        tag("launched_by_email").alias("owner"), tag("build").alias("build"), *order,
        elapsed_days(parse_iso(tag("launched_at")), now).alias("age_days"),
        elapsed_days(now, expires).alias("expires_days"),
        expires.alias("expires_at"))
    rows = rows.filter(F.col("expires_days") <= within_days)
    # render the date once per item, after the collapse (the shuffle carries a timestamp)
    last = last_by(rows, ["owner", "build"], order).withColumn("expires_on", expiry_phrase(F.col("expires_at")))
    age_text = _age_text(F.col("age_days"))
    item = F.when(age_text.isNotNull() & F.col("expires_on").isNotNull(),
                  F.format_string(EXPIRY_DIGEST_ITEM_FORMAT, F.col("build"), age_text, F.col("expires_on")))
    items = last.select("owner", "build", "age_days", "expires_days", "expires_on", item.alias("item_text"),
                        F.lit(EXPIRY_DIGEST_HEADING).alias("heading"),
                        F.concat(F.lit(extend_url), F.col("build")).alias("link"))
    # expires_days <= within_days above: never null
    return with_owner_header(items, subject_prefix, count_column="expires_days").orderBy("owner", "build")
