"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdeck.session import ensure_checkpoint_dir

SALTS = 16
MOST_HOT = 256  # hot keys at most


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, its lineage cut."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(many: DataFrame, one: DataFrame, key: str, spread_by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on ``key`` where ``many`` may have hot keys and ``one`` has a row per key: the rows
    of a hot key go to ``salts`` tasks, for which ``one`` is repeated.

    Always a shuffled join: the planner takes the size of ``one`` from compressed files and
    from before it is repeated, so what it would broadcast can be far larger than it thinks.
    """
    salt = "salt__"
    left = many.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [key, salt], how).drop(salt)


def spread_join(many: DataFrame, one: DataFrame, key: str, spread_by: str, n_many: int, also: DataFrame | None = None,
                salts: int = SALTS) -> DataFrame:
    """Inner join of ``many`` with ``one`` on ``key``, the rows of hot keys dealt over ``salts`` tasks.

    ``one`` has a row per key, with its number of rows in ``many`` or more as ``n``; ``n_many`` is the
    number of all rows of ``many``. A key is hot if it has more than one ``MOST_HOT``-th of them, so
    the list of hot keys is bounded and may be broadcast; rows of other keys are not repeated.
    With ``also``, ``many`` is joined with that table, which may have many rows per key, and ``one``
    only says which keys are hot.
    """
    salt = "salt__"
    hot = one.filter(F.col("n") > max(1000, n_many // MOST_HOT)).select(key, F.lit(True).alias("hot__"))
    left = many.join(F.broadcast(hot), key, "left").withColumn(
        salt, F.when(F.col("hot__"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)).drop("hot__")
    right = one if also is None else also.join(F.broadcast(hot), key, "left")
    is_hot = F.col("n") > max(1000, n_many // MOST_HOT) if also is None else F.coalesce("hot__", F.lit(False))
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(0)))).drop("hot__")
    return left.join(right.hint("merge"), [key, salt]).drop(salt)


def connected(links: DataFrame) -> DataFrame:
    """(node, label): for every node that has a link, the smallest node it reaches.

    ``links`` has two columns of one type. Each round hangs every node's larger neighbours,
    then all its smaller ones, below the smallest; it ends when nothing changes. The driver
    sees a count and a checksum per round. A round's rows are as many as links and their nodes:
    only nodes with a large share of all links are repeated in its joins.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = written(edges, "links"), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before, n = now, now[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        larger = spread_join(both, least, "u", "v", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = written(larger, "larger")  # read twice, computed once; a row per link
        least = larger.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = spread_join(larger, least, "u", "v", n)
        smaller = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                  F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(smaller.filter("u <> v").distinct(), "links")
