"""Shared fleet filters and per-instance columns used by all inventory reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.constants import ROLE_TAG_VALUE
from opsdeck.functions.tags import tag_equals

ORDER = ("res_pos", "inst_pos")


def test_fleet(instances: DataFrame, role: str = ROLE_TAG_VALUE) -> DataFrame:
    """Instances whose ``role`` tag equals ``role`` (the listing filter of every report)."""
    return instances.filter(tag_equals("role", role))


def in_state(state: str) -> Column:
    """Filter predicate on the instance state. Left as a plain comparison (a null state is
    dropped by the filter anyway) so that it is pushed into the scan."""
    return F.col("state") == F.lit(state)


def is_state(state: str) -> Column:
    """Boolean output column: the instance is in ``state`` (false, never null, when unknown)."""
    return F.coalesce(F.col("state") == F.lit(state), F.lit(False))


def order_columns(instances: DataFrame, order=ORDER) -> list[str]:
    """Document-order columns: any page/snapshot column first, then the positions."""
    lead = [c for c in ("page",) if c in instances.columns]
    return lead + list(order)
