"""Positions in a global order, and lists in bounded parts made from them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opsdeck.operators.positions import joined_in_parts, with_group_positions, with_positions


def rows_df(spark, n=500):
    # one owner holds half of the rows
    return spark.range(0, n, numPartitions=7).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 20)).alias("owner"),
        F.format_string("b%04d", (F.col("id") * 37) % n).alias("build"))


def test_positions_follow_the_order(spark):
    got = with_positions(rows_df(spark), [F.desc("owner"), "build"]).collect()
    want = sorted(((r.owner, r.build) for r in got), key=lambda r: r[1])
    want.sort(key=lambda r: r[0], reverse=True)
    assert [(r.owner, r.build) for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(1, 501))


def test_positions_of_an_empty_table(spark):
    assert with_positions(rows_df(spark).limit(0), ["owner", "build"]).count() == 0


def test_positions_within_a_hot_owner(spark):
    got = with_group_positions(rows_df(spark), "owner", ["build"], "build")
    # no window: the rows of one owner never meet in one task
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    owners = {}
    for r in sorted(got.collect(), key=lambda r: r.position):
        owners.setdefault(r.owner, []).append((r.position, r.build))
    assert len(owners["hot"]) == 250
    for rows in owners.values():
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
        assert [b for _, b in rows] == sorted(b for _, b in rows)


def test_parts_joined_again_are_the_list(spark):
    placed = with_positions(rows_df(spark, 50), ["build"])
    parts = sorted(joined_in_parts(placed, F.col("build"), "position", 7, " | ").collect(), key=lambda r: r.part)
    assert [r.n_items for r in parts] == [7] * 7 + [1] and [r.first_position for r in parts] == list(range(1, 51, 7))
    assert " | ".join(r.text for r in parts) == " | ".join(f"b{i:04d}" for i in range(50))
    with pytest.raises(ValueError):
        joined_in_parts(placed, F.col("build"), "position", 0, "")
