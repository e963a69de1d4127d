import hashlib
import math

import duckdb
import pytest
from llm_helpers import make_docs
from pyspark.sql import functions as F

from opsdeck.llm import mixing

SF = "/root/testdata/sf0.001"


def drawn(doc_id, rate, seed=0):
    parts = max(1, math.ceil(rate / mixing.PART_MEAN))
    mean, total = rate / parts, 0
    for part in range(1, parts + 1):
        key = f"{seed}|count|{part}|{doc_id}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2 ** 52
        k, p = 0, math.exp(-mean)
        c = p
        while c <= u:
            k += 1
            p = p * mean / k
            c += p
        total += k
    return total


@pytest.mark.parametrize("rate", [0.05, 0.7, 1.0, 3.5, 40.0, 300.0])
def test_counts_invert_the_distribution(spark, rate):
    n = 200
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    out = mixing.mix_sources(docs, {"a": 1.0}, target_rows=round(rate * n))
    got = {r.doc_id: r.n_copies for r in out.collect()}
    want = {i: drawn(i, round(rate * n) / n) for i in range(n)}
    assert got == {i: k for i, k in want.items() if k}
    assert abs(sum(want.values()) / n - rate) < 5 * math.sqrt(rate / n)


def test_weights_move_the_sources_to_their_target(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(
        F.concat(F.lit("s"), F.col("id") % 2)).alias("source"))
    assert mixing.source_rates(docs)["hot"] == pytest.approx(6000 / 3 / 4000)
    shares = {r.source: r["count"] for r in mixing.mix_sources(docs, {"hot": 1, "s0": 3, "s1": 0}).groupBy("source").count().collect()}
    assert set(shares) == {"hot", "s0"} and abs(shares["hot"] - 1500) < 200 and abs(shares["s0"] - 4500) < 350


def test_edges(spark):
    docs = make_docs(spark, [None, "", "x" * 100_000, "same", "same"] * 6)
    docs = docs.union(docs.filter("doc_id < 4")).withColumn("copy", F.lit("mine")).withColumn("mix_cdf", F.lit(1))
    out = mixing.mix_sources(docs, target_rows=500)
    assert set(docs.columns) < set(out.columns) and "_copy" in out.columns
    assert {r["copy"] for r in out.select("copy").distinct().collect()} == {"mine"}
    assert out.filter("source is null").count() > 0                              # a source of its own
    both = {r.doc_id: (r["count"], r.n) for r in out.filter("doc_id < 4").groupBy("doc_id").agg(
        F.count("*").alias("count"), F.max("n_copies").alias("n")).collect()}
    assert all(count == 2 * n for count, n in both.values())                     # repeated rows draw alike
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, {"other": 1.0}).count() == 0
    nulls = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.mix_sources(nulls, target_rows=30).groupBy("_copy").count().count() > 0
    with pytest.raises(ValueError):
        mixing.source_rates(docs, {"s1": -1.0})
    with pytest.raises(ValueError):
        mixing.source_rates(docs, max_sources=1)


def test_no_python_in_the_plan(spark):
    plan = mixing.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = mixing.query(spark, SF)
    want = con.execute(mixing.ORACLE).df()[rows.columns]
    assert sorted(map(tuple, rows.collect())) == sorted(want.itertuples(index=False, name=None))
