"""Mixing sources to target weights by Poisson replication.

Every row gets the number of copies that inverts a Poisson distribution at a uniform number
seeded by a hash of its id; the mean is its source's target repetition rate
``weight / sum of weights * target rows / rows of the source``. Rows are exploded by their
count and dealt out over all partitions in a hash order. DataFrame functions only.

Defined results: a null source is a source of its own; sources without a weight and sources
with weight 0 get no copies; rows that repeat an id (null ids included) get equal counts; an
empty table gives an empty table. Text columns are carried along untouched, null or long.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsdeck.llm.common import fresh

#: A rate is split into equal parts of this mean at most (a sum of independent Poisson
#: numbers is Poisson), so that exp(-mean) never underflows and the inverse stays short.
PART_MEAN = 64.0
#: More sources than this are refused: their rates are held by the driver and broadcast.
MAX_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts joined by ``|``."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None,
                 target_rows: int | None = None, source_col: str = "source",
                 max_sources: int = MAX_SOURCES) -> dict[str | None, float]:
    """Target repetition rate of each source: mean copies of one of its rows.

    ``weights`` need not add up to 1; None weighs all sources alike. ``target_rows`` is the
    expected number of rows of the mix (None: as many as there are). One partial + final
    count per source; at most ``max_sources`` rows reach the driver, more are an error.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).count().limit(max_sources + 1).collect()
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows = {r["source"]: r["count"] for r in counts}
    given = {s: 1.0 for s in rows} if weights is None else weights
    used = {s: float(given.get(s, 0.0)) for s in rows}
    if any(not math.isfinite(w) or w < 0 for w in used.values()):
        raise ValueError("weights must be finite and not negative")
    whole = math.fsum(used.values())
    target = sum(rows.values()) if target_rows is None else target_rows
    return {s: used[s] / whole * target / rows[s] if whole else 0.0 for s in rows}


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *,
                target_rows: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source",
                copy_col: str = "copy", copies_col: str = "n_copies", order_col: str = "order_key",
                max_sources: int = MAX_SOURCES) -> DataFrame:
    """All columns of ``docs``, one row per copy, dealt out and sorted by a hash.

    Adds the copy's number from 1, the row's number of copies and the order key; an added
    name that ``docs`` already has gets leading underscores.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, target_rows, source_col, max_sources)
    source, cdf, parts = fresh(docs, "mix_source"), fresh(docs, "mix_cdf"), fresh(docs, "mix_parts")
    schema = T.StructType([T.StructField(source, T.StringType()), T.StructField(parts, T.IntegerType()),
                           T.StructField("mean", T.DoubleType())])
    rows = [(s, max(1, math.ceil(r / PART_MEAN)), r / max(1, math.ceil(r / PART_MEAN))) for s, r in rates.items()]
    table = spark.createDataFrame(rows, schema).select(source, parts, poisson_cdf(F.col("mean")).alias(cdf))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\\N"))
    copies, copy, order = fresh(docs, copies_col), fresh(docs, copy_col), fresh(docs, order_col)
    # bounded by max_sources rows of a few hundred numbers
    joined = docs.join(F.broadcast(table), F.col(source_col).cast("string").eqNullSafe(F.col(source)))

    def drawn(part: Column) -> Column:
        u = uniform(F.lit(str(seed)), F.lit("count"), part.cast("string"), key)
        return F.size(F.filter(F.col(cdf), lambda c: c <= u))

    counted = joined.withColumn(copies, F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0),
                                                    lambda acc, part: acc + drawn(part)))
    exploded = counted.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    keyed = exploded.withColumn(order, F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"),
                                                         F.col(copy).cast("string"), key)))
    # the key is a hash, so hash partitions of it are a random deal; the sort orders each
    return keyed.drop(source, parts, cdf).repartition(F.col(order)).sortWithinPartitions(order)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k from 0 until the rest is below the resolution of the uniform number.

    The number of entries that do not exceed u is the inverse of the distribution at u.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def query(spark, sf_dir: str) -> DataFrame:
    """Every source of ``documents`` weighed alike, as many rows as there are expected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "source", "copy", "n_copies", "order_key",
                        F.sha2(F.col("text"), 256).alias("text_sha256"))


ORACLE = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
whole AS (SELECT sum(n) AS target, count(*) * 1.0::DOUBLE AS weights FROM sizes),
rates AS (SELECT source, 1.0::DOUBLE / weights * target / n AS rate FROM sizes, whole),
parts AS (SELECT source, greatest(1, ceil(rate / 64.0))::INTEGER AS parts,
                 rate / greatest(1, ceil(rate / 64.0)) AS mean FROM rates),
cdf AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
        UNION ALL
        SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf
        WHERE k < ceil(mean + 12 * sqrt(mean) + 40)),
draws AS (SELECT d.doc_id, d.source, d.text, unnest(range(1, parts + 1)) AS part
          FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
uniforms AS (SELECT *, ('0x' || substr(md5('0|count|' || part || '|' || coalesce(doc_id::VARCHAR, '\\N')), 1, 13))::BIGINT
                       / 4503599627370496.0::DOUBLE AS u FROM draws),
counts AS (SELECT u.doc_id, u.source, u.text, count(*) AS n_copies
           FROM uniforms u JOIN cdf c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u
           GROUP BY u.doc_id, u.source, u.text),
copies AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counts)
SELECT doc_id, source, copy::INTEGER AS copy, n_copies::INTEGER AS n_copies,
       md5('0|order|' || copy || '|' || coalesce(doc_id::VARCHAR, '\\N')) AS order_key, sha256(text) AS text_sha256
FROM copies
"""
