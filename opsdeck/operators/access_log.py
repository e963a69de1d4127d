"""Access-log parsing and per-endpoint aggregation.

Plan shape: text scan -> Filter(contains marker) -> Project(one regexp_replace)
-> Generate(keep matched) -> Project(split) -> HashAggregate(partial) -> Exchange(method,
url) -> HashAggregate(final).
The partial aggregate is a map-side combine, so a hot endpoint costs one row per map task
in the shuffle, not one row per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.constants import LOG_PATTERN, STATUS_CLASSES

PARSED_COLUMNS = ("resp_time_ms", "status", "resp_bytes", "method", "url")


def parse_access_log(lines: DataFrame, marker: str | None, pattern: str = LOG_PATTERN,
                     strategy: str = "single", value: str = "value") -> DataFrame:
    """Lines -> ``resp_time_ms double, status bigint, resp_bytes bigint, method string, url string``.

    Keeps lines that contain ``marker`` (a cheap substring test that runs before any regex)
    and in which ``pattern`` matches somewhere; the first match supplies the five groups.
    ``pattern`` must have five groups, none of which can contain a space.

    ``strategy="single"`` evaluates the regex once per line: the whole line is rewritten to
    the five groups separated by spaces. A rewrite is always shorter than the line it came
    from (the match holds at least seven characters besides the groups, the rewrite four), so
    "rewritten text differs from the line" is exactly "the pattern matched".
    ``strategy="extract"`` runs ``rlike`` plus one ``regexp_extract`` per group (six passes).
    """
    line = F.col(value)
    df = lines.filter(line.contains(marker)) if marker else lines
    if strategy == "single":
        whole = "(?s)^.*?" + pattern + ".*$"
        packed = F.regexp_replace(line, F.lit(whole), F.lit("$1 $2 $3 $4 $5"))
        rewritten = df.select(packed.alias("_packed"), line.alias("_line"))
        # Keep matched lines with an explode of a zero-or-one element array rather than a
        # Filter: the optimizer pushes a Filter below the projection and substitutes the
        # regexp_replace into it, which would run the regex twice per line.
        matched = F.when(F.col("_packed") != F.col("_line"), F.array(F.col("_packed")))
        df = rewritten.select(F.explode(matched).alias("_packed"))
        parts = F.split(F.col("_packed"), " ")
        groups = [parts.getItem(i) for i in range(5)]
    elif strategy == "extract":
        df = df.filter(line.rlike(pattern))
        groups = [F.regexp_extract(line, pattern, i) for i in range(1, 6)]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.select(*_typed(groups))


def _typed(groups: list[Column]) -> list[Column]:
    resp_time, status, size, method, url = groups
    return [
        resp_time.cast("double").alias("resp_time_ms"),
        status.try_cast("bigint").alias("status"),
        size.try_cast("bigint").alias("resp_bytes"),
        method.alias("method"),
        url.alias("url"),
    ]


def endpoint_aggregate(requests: DataFrame) -> DataFrame:
    """Per (method, url): request count, mean time and size over all requests, status-class counts.

    Statuses outside the listed classes (1xx, 3xx, ...) raise only the request count.
    """
    status = F.col("status")
    return requests.groupBy("method", "url").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("resp_time_ms").alias("avg_resp_time_ms"),
        F.avg("resp_bytes").alias("avg_resp_bytes"),
        *[F.count_if(status.between(lo, hi)).alias(name) for name, lo, hi in STATUS_CLASSES],
    )


def top_endpoints(stats: DataFrame, limit: int | None) -> DataFrame:
    """Busiest endpoints first; ties broken by method then url so the cut is deterministic.

    With a limit this plans as TakeOrderedAndProject (per-partition top-k, then a merge of
    ``limit`` rows per partition), never a full sort.
    """
    ordered = stats.orderBy(F.desc("requests"), F.asc("method"), F.asc("url"))
    return ordered.limit(limit) if limit is not None else ordered
