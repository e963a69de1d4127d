"""Positions of rows in a global order, without a one-task window.

A window without partitions numbers all rows in one task. Here the rows are range-partitioned by
the order and sorted, and written once as a table with the number that each has in its partition;
what lies before each partition (a sum over at most as many counts as there are shuffle
partitions) is then added. The table also holds the borders fixed: Spark samples them anew each
time the plan runs, so counting and numbering must read the same rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.operators.joins import salted_join
from opsdeck.sources.landing import land

_AT, _PART, _BEFORE, _START = "_at", "_part", "_before", "_start"
_IN_PARTITION = 33  # bits of monotonically_increasing_id that count within a partition


def with_positions(rows: DataFrame, order: list[Column | str], position_col: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, in ``order`` (which must leave no two different rows equal).

    Runs two jobs: the write, and the count of rows per partition. The driver sees one number per
    partition, and they are broadcast: at most ``spark.sql.shuffle.partitions`` rows.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = land(ranged.withColumn(_AT, F.monotonically_increasing_id()), "positions")
    table = table.withColumn(_PART, F.shiftright(_AT, _IN_PARTITION).cast("int"))
    counts = sorted(table.groupBy(_PART).count().collect())
    before = accumulate((n for _, n in counts), initial=0)
    known = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], f"{_PART} int, {_BEFORE} bigint")
    within = F.col(_AT).bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    return table.join(F.broadcast(known), _PART).withColumn(position_col, F.col(_BEFORE) + within + 1).drop(_AT, _PART, _BEFORE)


def with_group_positions(rows: DataFrame, key: str, order: list[Column | str], spread_by: str,
                         position_col: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, among the rows of the same ``key`` (not null).

    A key's rows follow one another in the global order of key and ``order``, so their places are
    those less the smallest of the key. A key with a third of all rows lies on many partitions of
    that order, and is dealt over tasks by ``spread_by`` when its smallest place is joined back.
    """
    placed = with_positions(rows, [key, *order], position_col)
    starts = placed.groupBy(key).agg(F.min(position_col).alias(_START))
    return salted_join(placed, starts, key, spread_by).withColumn(position_col, F.col(position_col) - F.col(_START) + 1).drop(_START)


def joined_in_parts(rows: DataFrame, text: Column, position_col: str, per_part: int, separator: str,
                    keys: list[str] | None = None) -> DataFrame:
    """(keys, part, first_position, n_items, text): the rendered items in order of their position, joined by
    ``separator``, in parts (from 1) of at most ``per_part`` items.

    Parts joined by the separator are the whole list. A row without a text is left out of its part's text.
    """
    if per_part < 1:
        raise ValueError("a part holds one item at least")
    part = (F.floor((F.col(position_col) - 1) / F.lit(per_part)) + 1).cast("bigint")
    items = rows.select(*(keys or []), part.alias("part"), F.col(position_col).alias("_position"), text.alias("_text"))
    grouped = items.groupBy(*(keys or []), "part").agg(
        F.min("_position").alias("first_position"), F.count(F.lit(1)).alias("n_items"),
        F.array_sort(F.collect_list(F.struct("_position", "_text"))).alias("_items"))
    texts = F.transform("_items", lambda i: i["_text"])
    return grouped.select(*(keys or []), "part", "first_position", "n_items", F.array_join(texts, separator).alias("text"))
