"""Tag tests over a ``tags map<string,string>`` column (instance tags).

Convention: a tag is present when its value is non-null; a null value and a missing key
both mean "absent" (the cloud API never returns null tag values).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(key: str, tags: str | Column = "tags") -> Column:
    """Value of one tag; null when the tag is missing.

    ``element_at`` rather than ``tags[key]``: the latter is null-intolerant, and constraint
    inference then derives not-null facts through whatever expression built the map, which
    can grow combinatorially when that expression has many branches.
    """
    return F.element_at(_col(tags), F.lit(key))


def truthy(value: Column) -> Column:
    """Script-style truth: missing, empty and ``'0'`` are all false. Never null."""
    return F.coalesce(~value.isin("", "0"), F.lit(False))


def tag_truthy(key: str, tags: str | Column = "tags") -> Column:
    return truthy(tag(key, tags))


def tag_equals(key: str, value: str, tags: str | Column = "tags") -> Column:
    """Tag present with exactly this value. Never null."""
    return F.coalesce(tag(key, tags) == F.lit(value), F.lit(False))


def tag_exists(key: str, tags: str | Column = "tags") -> Column:
    """Tag present with any value, the empty value included."""
    return tag(key, tags).isNotNull()


def present_and_not(value: Column, *excluded: str) -> Column:
    """Value present, not empty and none of ``excluded`` (a missing value counts as empty)."""
    return ~F.coalesce(value, F.lit("")).isin("", *excluded)


def entries_to_map(entries: str | Column, key_field: str = "Key", value_field: str = "Value") -> Column:
    """Array of (key, value) structs -> map; when a key repeats, the last entry wins.

    Rows whose keys are unique and non-null (the normal case) take a code-generated path,
    ``map_from_arrays``; the test is one ``array_except`` (drops nulls and repeats). Other
    rows take a left fold that removes an earlier entry of the same key before adding each
    entry and skips null keys, so the result never depends on the session's
    ``spark.sql.mapKeyDedupPolicy``. A null array gives an empty map.
    """
    arr = F.coalesce(_col(entries), F.array().cast(
        f"array<struct<{key_field}:string,{value_field}:string>>"))
    keys, values = arr[key_field], arr[value_field]
    clean = F.size(F.array_except(keys, F.array(F.lit(None).cast("string")))) == F.size(keys)
    empty = F.create_map().cast("map<string,string>")

    def step(acc: Column, e: Column) -> Column:
        key = e[key_field]
        kept = F.map_filter(acc, lambda k, _v: k != key)
        return F.when(key.isNull(), acc).otherwise(F.map_concat(kept, F.create_map(key, e[value_field])))

    return F.when(clean, F.map_from_arrays(keys, values)).otherwise(F.aggregate(arr, empty, step))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
