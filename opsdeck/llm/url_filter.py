"""URL filter: host and path rules first, a character language-model ratio for the rest.

Two variable-order Markov models over URL characters are trained on all URLs that an allow
rule and a block rule decides, except a fifth held back by hash. Each order's estimate is
smoothed by the next lower one (Witten-Bell): an order that has not seen the context passes
the lower order's probability on, so the order used varies with the context. A URL's score is
the difference of the two log-likelihoods divided by its length (the end counts as a
character); the threshold is calibrated on the fifth held back, as the score that makes the
mean of both classes' error rates smallest.

The counts lie in tables of fixed size (contexts of three and four characters are hashed), so
what reaches the driver and what is broadcast is bounded whatever the input; map tasks add up
their own counts before the shuffle, so a hot host costs nothing extra.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no
rule; a null URL is judged as the empty string. Without URLs of both classes every score is 0
and the method allows. Rows are kept as they are, repeated ones included.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.llm.common import fresh

#: The rules of the registered query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SYMBOLS = 64
#: Contexts of order 0 to 4; orders 3 and 4 are hashed.
CONTEXTS = (1, SYMBOLS, SYMBOLS ** 2, 1 << 14, 1 << 14)
_FIRST = np.concatenate(([0], np.cumsum(CONTEXTS)))
SIZE = int(_FIRST[-1]) * SYMBOLS
END = SYMBOLS - 1
BINS, REACH = 4000, 10.0  # of the calibration's score histogram

_SYMBOL = np.full(256, SYMBOLS - 2, dtype=np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#@!$&'()*+,;=%"):
    _SYMBOL[ord(_c)] = _i
for _c in string.ascii_uppercase:
    _SYMBOL[ord(_c)] = _SYMBOL[ord(_c.lower())]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty strings where there are none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def cells(urls: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the table cells (context, character) of all URLs' characters, and the
    URL of each character. Every URL ends with the end symbol and is preceded by it."""
    raw = [u or b"" for u in urls]
    buf = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    size = np.array([len(u) + 1 for u in raw], dtype=np.int64)
    symbol = _SYMBOL[buf]
    ends = np.cumsum(size) - 1
    symbol[ends] = END
    url = np.repeat(np.arange(len(raw)), size)
    place = np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size)
    out, context = [symbol.copy()], np.zeros(len(symbol), dtype=np.int64)
    for k in range(1, len(CONTEXTS)):
        before = np.full(len(symbol), END, dtype=np.int64)
        before[k:] = symbol[:-k] if k <= len(symbol) else []
        before[place < k] = END
        context = context * SYMBOLS + before
        slot = context if k < 3 else ((context * 0x9E3779B1 + k) >> 7) % CONTEXTS[k]
        out.append((_FIRST[k] + slot) * SYMBOLS + symbol)
    return out, url


@dataclass
class Model:
    """Counts of two classes and what the smoothing needs, as dense tables."""

    counts: np.ndarray  # [2, SIZE]

    def __post_init__(self):
        by = self.counts.reshape(2, -1, SYMBOLS)
        self.seen = by.sum(axis=2)
        self.kinds = (by > 0).sum(axis=2)

    def score(self, urls: list[bytes | None]) -> np.ndarray:
        """Length-normalised log-likelihood difference, accepted minus rejected."""
        if not urls:
            return np.zeros(0)
        if not self.counts.sum(axis=1).all():
            return np.zeros(len(urls))
        at, url = cells(urls)
        logs = []
        for c in (0, 1):
            p = np.full(len(url), 1.0 / SYMBOLS)
            for cell in at:
                context = cell // SYMBOLS
                seen, kinds = self.seen[c][context], self.kinds[c][context]
                p = np.where(seen > 0, (self.counts[c][cell] + kinds * p) / np.maximum(seen + kinds, 1), p)
            logs.append(np.bincount(url, np.log(p), minlength=len(urls)))
        return (logs[0] - logs[1]) / np.bincount(url, minlength=len(urls))


def _in_turn(batch: pa.RecordBatch, size: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def train(labelled: DataFrame, url_col: str, accepted_col: str) -> Model:
    """Counts over all rows: each task adds up its rows, then one sum per table cell."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE), dtype=np.int64)
        for batch in batches:
            for part in _in_turn(batch):
                at, url = cells(part.column(0).to_pylist())
                reject = 1 - np.array(part.column(1).to_pylist(), dtype=np.int64)[url]
                for cell in at:
                    total += np.bincount(reject * SIZE + cell, minlength=2 * SIZE).reshape(2, SIZE)
        cell = np.flatnonzero(total)
        for i in range(0, len(cell), 100_000):
            some = cell[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], names=["cell", "n"])

    rows = labelled.select(F.col(url_col).cast("binary"), F.col(accepted_col).cast("int"))
    # at most 2 * SIZE rows, whatever the input
    sums = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(2 * SIZE, dtype=np.int64)
    counts[sums["cell"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return Model(counts.reshape(2, SIZE))


def scorer(spark, model: Model):
    held = spark.sparkContext.broadcast(model.counts)
    made: list[Model] = []

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(Model(held.value))
        for batch in batches:
            urls = batch.to_pylist()
            parts = [made[0].score(urls[i:i + 2000]) for i in range(0, len(urls), 2000)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score


def calibrate(scored: DataFrame, score_col: str, accepted_col: str) -> float:
    """The threshold with the least mean error rate of both classes; of several the one
    nearest 0. A histogram of fixed size is all that reaches the driver."""
    spot = F.floor((F.least(F.greatest(F.col(score_col), F.lit(-REACH)), F.lit(REACH)) + REACH) / (2 * REACH) * BINS)
    found = scored.groupBy(F.col(accepted_col).cast("int").alias("accepted"), spot.cast("int").alias("spot")).count().collect()
    hist = np.zeros((2, BINS + 1))
    for r in found:
        hist[r["accepted"], r["spot"]] += r["count"]
    if not hist.sum(axis=1).all():
        return 0.0
    share = hist / hist.sum(axis=1, keepdims=True)
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(share, axis=1)), axis=1)
    error = below[1] + (1 - below[0])  # accepted below the threshold, rejected from it on
    edges = np.arange(BINS + 2) / BINS * 2 * REACH - REACH
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge(pages: DataFrame, rules=RULES, *, url_col: str = "url", host_col: str = "host", path_col: str = "path",
          rule_col: str = "rule", verdict_col: str = "verdict", score_col: str = "score") -> DataFrame:
    """All columns of ``pages`` with host, path, rule, score and verdict (columns of those
    names are replaced). Two small jobs train and calibrate first."""
    spark = pages.sparkSession
    host, path = host_path(F.coalesce(F.col(url_col), F.lit("")))
    added = pages.withColumn(host_col, host).withColumn(path_col, path)
    name, verdict = longest_rule(F.col(host_col), F.col(path_col), rules)
    added = added.withColumn(rule_col, name).withColumn(verdict_col, verdict)
    accepted, held = fresh(added, "accepted"), F.pmod(F.crc32(F.coalesce(F.col(url_col), F.lit(""))), F.lit(5)) == 0
    labelled = added.filter(F.col(verdict_col).isNotNull()).select(
        F.col(url_col), (F.col(verdict_col) == "allow").cast("int").alias(accepted))
    model = train(labelled.filter(~held), url_col, accepted)
    score = scorer(spark, model)
    check = labelled.filter(held).select(accepted, score(F.col(url_col).cast("binary")).alias(score_col))
    threshold = calibrate(check, score_col, accepted)
    out = added.withColumn(score_col, score(F.col(url_col).cast("binary")))
    by_method = F.when(F.col(score_col) >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return out.withColumn(verdict_col, F.coalesce(F.col(verdict_col), by_method))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
