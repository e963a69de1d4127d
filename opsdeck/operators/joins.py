"""Joins of rows with hot keys against a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
_SALT = "_salt"


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, spread_by: str, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join on ``key`` so that the rows of a hot key go to ``salts`` tasks.

    AQE splits a skewed join only if both sides are plain shuffles; an aggregated lookup is
    none. Here the rows are dealt by (key, hash of ``spread_by``), and the few lookup rows are
    repeated once per salt. Where the planner broadcasts the lookup instead, that is at most
    ``salts`` times its threshold.
    """
    # never null, so that no filter on it is pushed into one side and tells the two apart
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"), F.lit(0))
    left = rows.withColumn(_SALT, salt)
    right = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, _SALT], how).drop(_SALT)
