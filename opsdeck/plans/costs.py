"""Fleet cost figures from per-instance cost rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdeck.constants import (BOX_ITEM_FORMAT, BY_AGE_TITLE, BY_OWNER_TITLE, DAY_PRICE_PENCE, ITEM_SEPARATOR, LINK_FORMAT,
                               MESSAGE_LINK_TEXTS, TOTALS_FORMAT, USER_ITEM_FORMAT)
from opsdeck.functions.tags import tag
from opsdeck.functions.text import short_name, to_pounds
from opsdeck.functions.timefns import as_of_lit, elapsed_days
from opsdeck.operators.positions import joined_in_parts, with_positions
from opsdeck.plans.fleet import test_fleet

#: Pages to create and to terminate an instance, and the full listing.
DEFAULT_LINK_URLS = ("https://reports.example.test/create", "https://reports.example.test/terminate", "https://reports.example.test/instances")
ITEMS_PER_PART = 500


def cost_rows(instances: DataFrame, as_of, day_price: int = DAY_PRICE_PENCE) -> DataFrame:
    """Every test instance (any state, duplicates kept): short name, created, ip, owner,
    whole elapsed days since launch and the price so far in pence."""
    age = elapsed_days(F.col("launch_time"), as_of_lit(as_of))
    return test_fleet(instances).select(
        "instance_id",
        short_name(tag("hostname")).alias("short_name"),
        F.col("launch_time").alias("created"),
        "private_ip",
        tag("launched_by_name").alias("owner"),
        age.alias("age_days"),
        (age * F.lit(day_price)).alias("price_pence"),
    )


def cost_totals(costs: DataFrame, day_price: int = DAY_PRICE_PENCE) -> DataFrame:
    """One row: instances, summed days, price so far, price per day (zeros when empty)."""
    totals = costs.agg(
        F.count(F.lit(1)).alias("total_instances"),
        F.coalesce(F.sum("age_days"), F.lit(0)).cast("bigint").alias("total_days"),
        F.coalesce(F.sum("price_pence"), F.lit(0)).cast("bigint").alias("total_price_pence"),
    )
    todays = (F.col("total_instances") * F.lit(day_price)).alias("todays_price_pence")
    out = totals.select("*", todays)
    summary = F.format_string(TOTALS_FORMAT,
                              F.col("total_instances"), to_pounds(F.col("todays_price_pence")),
                              F.col("total_days"), to_pounds(F.col("total_price_pence")))
    return out.select("total_instances", "total_days", "total_price_pence", "todays_price_pence",
                      to_pounds(F.col("total_price_pence")).alias("total_price_pounds"),
                      to_pounds(F.col("todays_price_pence")).alias("todays_price_pounds"),
                      summary.alias("summary"))


def cost_by_box(costs: DataFrame, by: str = "age", numbered: bool = False) -> DataFrame:
    """One row per box with its rendered item; ``by="age"`` oldest first (age then name,
    both descending), ``by="name"`` by short name; ties by instance id. With ``numbered`` as a
    ``position`` column instead of sorted."""
    pounds = to_pounds(F.col("price_pence"))
    item = F.format_string(BOX_ITEM_FORMAT, F.col("short_name"), F.col("age_days"), pounds)
    item = F.when(F.col("short_name").isNotNull() & F.col("age_days").isNotNull(), item)
    boxes = costs.select("*", pounds.alias("price_pounds"), item.alias("item_text"))
    orders = {"age": [F.desc("age_days"), F.desc("short_name"), "instance_id"], "name": ["short_name", "instance_id"]}
    if by not in orders:
        raise ValueError(f"unknown order {by!r}")
    return with_positions(boxes, orders[by]) if numbered else boxes.orderBy(*orders[by])


def cost_by_owner(costs: DataFrame, numbered: bool = False) -> DataFrame:
    """Per owner (a missing owner is its own group): instance count and summed days."""
    per_owner = costs.groupBy("owner").agg(
        F.count(F.lit(1)).alias("instance_count"),
        F.coalesce(F.sum("age_days"), F.lit(0)).cast("bigint").alias("instance_days"),
    )
    item = F.format_string(USER_ITEM_FORMAT, F.col("owner"), F.col("instance_count"), F.col("instance_days"))
    users = per_owner.select("*", F.when(F.col("owner").isNotNull(), item).alias("item_text"))
    return with_positions(users, ["owner"]) if numbered else users.orderBy("owner")


def link_text(url: str, text: str) -> str:
    return LINK_FORMAT % (url, text)


def cost_message(costs: DataFrame, *, day_price: int = DAY_PRICE_PENCE, link_urls: Sequence[str] = DEFAULT_LINK_URLS,
                 items_per_part: int = ITEMS_PER_PART) -> DataFrame:
    """The cost message: its sections in order, a row per part of a section.

    Columns: section (1 totals and links, 2 boxes oldest first, 3 owners), title, part, n_items, text.
    Items are joined by `` | `` in parts of at most ``items_per_part``, so no row holds the whole
    fleet; a section's parts, joined likewise, are its whole list. Boxes or owners whose item can't be
    rendered (no short name, age or owner) count as items but are left out of the text.
    """
    links = ITEM_SEPARATOR.join(link_text(u, t) for u, t in zip(link_urls, MESSAGE_LINK_TEXTS, strict=True))
    message = cost_totals(costs, day_price).select(
        F.lit(1).alias("section"), F.lit(None).cast("string").alias("title"), F.lit(1).cast("bigint").alias("part"),
        F.col("total_instances").alias("n_items"), F.concat(F.col("summary"), F.lit("\n" + links)).alias("text"))
    lists = [(2, BY_AGE_TITLE, cost_by_box(costs, by="age", numbered=True)), (3, BY_OWNER_TITLE, cost_by_owner(costs, numbered=True))]
    for section, title, rows in lists:
        parts = joined_in_parts(rows, F.col("item_text"), "position", items_per_part, ITEM_SEPARATOR)
        message = message.unionByName(parts.select(F.lit(section).alias("section"), F.lit(title).alias("title"), "part", "n_items", "text"))
    return message
