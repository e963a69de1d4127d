"""Keyed "last write wins" collapses as aggregates (map-side combinable, skew-safe)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            keep_last_set: Sequence[str] = ()) -> DataFrame:
    """One row per key: the row with the greatest ``order`` (the last one written).

    Fields in ``keep_last_set`` instead keep their last non-null value, as when a later write
    skips a field. Written as ``max_by`` over a struct rather than a ``row_number`` window: the
    aggregate has a partial (map-side) phase, so a key holding a third of all rows ships one
    row per map task to the shuffle instead of its whole group to one task.
    """
    return _pick(df, keys, order, keep_last_set, F.max_by)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the row with the smallest ``order`` (the first one found)."""
    return _pick(df, keys, order, (), F.min_by)


def _pick(df, keys, order, keep_last_set, chooser) -> DataFrame:
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    whole = [c for c in rest if c not in keep_last_set]
    position = F.struct(*order)
    aggs = [chooser(F.struct(*whole), position).alias("_row")]
    for name in keep_last_set:
        value = F.col(name)
        aggs.append(chooser(value, F.when(value.isNotNull(), position)).alias(name))
    picked = df.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in whole], *keep_last_set) \
        .select(*keys, *rest)
