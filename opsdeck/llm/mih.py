"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by the signs of a learned rotation of their principal components
(iterative quantisation on a bounded sample). A code is split into substrings of 16 bits, each
with an index of its own. A query that looks for all codes within Hamming radius r probes, in
the index of substring j, every value within r_j of its own, where the r_j add up to
r - substrings + 1: by the pigeonhole principle no code within r escapes all indexes. The
codes found are checked against r, and the original vectors rerank them by exact distance.

The radius is calibrated on the sample: the least that covers ``RECALL`` of its true nearest
neighbours. A sample's neighbours lie farther away than those among all rows, so the radius is
on the safe side. Rows are dealt over blocks by a hash of their id and every block is indexed
whole; each block of queries visits each block of rows once. In a block with fewer than k codes
within r, the radius grows until there are k or the block is used up.

Defined results: vectors that are null, of another dimension than most, zero, or hold null or
non-finite components take no part, neither do rows without id; a query never finds a row of
its own id; ties go to the smaller id; an empty table gives an empty result. Repeated rows are
candidates of their own. Codes shared by many rows have long index entries, nothing is capped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
MAX_BITS = 64
SUB_BITS = 16
SAMPLE = 8192
RECALL = 0.98
ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
_POPCOUNT = np.array([bin(v).count("1") for v in range(1 << 16)], dtype=np.uint8)
_BY_WEIGHT = np.argsort(_POPCOUNT, kind="stable").astype(np.uint16)
_UP_TO = np.searchsorted(_POPCOUNT[_BY_WEIGHT], np.arange(18))


@dataclass
class Coder:
    """Centre and projection of the codes, and the calibrated radius."""

    centre: np.ndarray
    projection: np.ndarray  # dimensions x bits
    radius: int

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """The codes as 16-bit substrings (rows x substrings); missing bits are 0."""
        bits = (x - self.centre) @ self.projection > 0
        pad = -bits.shape[1] % SUB_BITS
        packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)
        return packed.reshape(len(x), -1, 2).astype(np.uint16) @ np.array([256, 1], dtype=np.uint16)


def fit_rotation(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and rotated principal directions whose signs lose least."""
    centre = sample.mean(axis=0)
    z = sample - centre
    _, vector = np.linalg.eigh(z.T @ z)
    principal = vector[:, ::-1][:, :bits]
    p = z @ principal
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(p.shape[1], p.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(p @ rotation > 0, 1.0, -1.0).T @ p)
        rotation = (u @ v).T
    return centre, principal @ rotation


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POPCOUNT[a ^ b].sum(axis=-1, dtype=np.int64)


def fit(sample: np.ndarray, k: int = K, recall: float = RECALL, bits: int = MAX_BITS) -> Coder:
    bits = min(bits, sample.shape[1])
    coder = Coder(*fit_rotation(sample, bits), bits)
    code = coder.substrings(sample)
    reach = []
    for i in range(min(256, len(sample))):
        distance = ((sample - sample[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        near = np.argsort(distance, kind="stable")[:min(k, len(sample) - 1)]
        reach += hamming(code[near], code[i]).tolist()
    if reach:
        coder.radius = int(np.sort(reach)[min(len(reach) - 1, math.ceil(recall * len(reach)))])
    return coder


class Index:
    """The substring indexes of a block of codes."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.rows, self.starts = [], []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            self.rows.append(order)
            self.starts.append(np.searchsorted(code[order, j], np.arange((1 << SUB_BITS) + 1)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs from the given one in at most ``radius`` bits."""
        m = self.code.shape[1]
        hit = np.zeros(len(self.code), dtype=bool)
        spare = radius - m + 1  # split over the substrings; a negative share needs no probe
        for j in range(m):
            share = (spare + j) // m
            if share < 0:
                continue
            value = _BY_WEIGHT[:_UP_TO[min(share, SUB_BITS) + 1]] ^ code[j]
            start, end = self.starts[j][value], self.starts[j][value.astype(np.int64) + 1]
            some = end > start
            start, size = start[some], (end - start)[some]
            if len(size):
                first = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
                hit[self.rows[j][np.arange(size.sum()) + first]] = True
        found = np.flatnonzero(hit)
        return found[hamming(self.code[found], code) <= radius]


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, coder: Coder, k: int) -> pd.DataFrame:
    """Each query's k nearest of the block's rows found."""
    index, codes = Index(coder.substrings(x)), coder.substrings(queries)
    all_bits = SUB_BITS * codes.shape[1]
    out = []
    for q, vector, code in zip(query_ids, queries, codes, strict=True):
        radius = coder.radius
        while True:
            near = index.within(code, radius)
            near = near[ids[near] != q]
            if len(near) >= k or radius >= all_bits:
                break
            radius = min(all_bits, radius + codes.shape[1])
        distance = np.sqrt(((x[near] - vector) ** 2).sum(axis=1))
        best = np.lexsort((ids[near], distance))[:k]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near][best], "score": distance[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vector: Column) -> Column:
    """Not null, every component finite and at least one not 0."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            sample_size: int = SAMPLE, recall: float = RECALL, rows_per_block: int = ROWS_PER_BLOCK,
            queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank from 1, vec_id and score (Euclidean distance) of each query's k nearest.

    Small jobs first: the common dimension, the number of rows, and a sample of at most
    ``sample_size`` vectors for the codes.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"),
                          F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("x")))
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"))
    most = sizes.orderBy(F.desc("n"), "dims").first()
    if most is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == most["dims"])
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(sample_size).select("x").collect()
    held = spark.sparkContext.broadcast(fit(np.array([r["x"] for r in sample]), k, recall))
    n_blocks = math.ceil(most["n"] / rows_per_block)
    n_queries = max(1, math.ceil(most["q"] / queries_per_block))
    place = F.xxhash64("vec_id", F.lit("block"))
    block, turn = F.pmod(place, F.lit(n_blocks)).cast("int"), F.pmod(place, F.lit(n_queries)).cast("int")
    # every block of queries meets every block of rows once
    left = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("turn"), "vec_id", "x")
    right = rows.filter("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
                                           turn.alias("turn"), "vec_id", "x")

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(data["vec_id"].to_numpy(), np.stack(data["x"].to_numpy()), asked["vec_id"].to_numpy(),
                            np.stack(asked["x"].to_numpy()), held.value, k)

    found = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(
        search, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 100, against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
