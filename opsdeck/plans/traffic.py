"""Per-endpoint traffic statistics from proxy access-log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdeck.constants import DEFAULT_TOP_N
from opsdeck.functions.urls import Rule, lenient_url_decode, normalize_url
from opsdeck.operators.access_log import endpoint_aggregate, parse_access_log, top_endpoints


def requests_by_endpoint(lines: DataFrame, marker: str | None, rules: Sequence[Rule],
                         strategy: str = "single") -> DataFrame:
    """Parsed requests keyed by method and decoded, normalised URL."""
    parsed = parse_access_log(lines, marker, strategy=strategy)
    return parsed.select("method", normalize_url(lenient_url_decode(F.col("url")), rules).alias("url"),
                         "resp_time_ms", "resp_bytes", "status")


def endpoint_stats(lines: DataFrame, marker: str | None, rules: Sequence[Rule],
                   limit: int | None = DEFAULT_TOP_N, strategy: str = "single") -> DataFrame:
    """``method, url, requests, avg_resp_time_ms, avg_resp_bytes, n_2xx, n_4xx, n_5xx``,
    busiest first; ``limit=None`` keeps every endpoint."""
    stats = endpoint_aggregate(requests_by_endpoint(lines, marker, rules, strategy))
    return top_endpoints(stats, limit)


def normalized_urls(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Adds ``normalized_url``: percent-decoded, then rewritten by ``rules``."""
    return urls.withColumn("normalized_url", normalize_url(lenient_url_decode(F.col(url)), rules))
