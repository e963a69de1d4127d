import numpy as np
import pytest
from pyspark.sql import functions as F

from opsdeck.llm import mih


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("bits", [16, 24, 64])
def test_index_finds_every_code_within_the_radius(bits):
    rng = np.random.default_rng(bits)
    x = rng.normal(size=(500, bits))
    coder = mih.fit(x)
    codes = coder.substrings(x)
    index = mih.Index(codes)
    for radius in (0, 1, 3, 7, 12, bits // 2, bits, 2 * bits):
        for i in range(0, 500, 97):
            want = np.flatnonzero(mih.hamming(codes, codes[i]) <= radius)
            assert (index.within(codes[i], radius) == want).all()


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    n, dim = 3000, 32
    x = rng.normal(size=(n, dim)) if kind == "random" else rng.normal(size=(10, dim))[np.arange(n) % 10] + 0.3 * rng.normal(size=(n, dim))
    x = x.astype(np.float32).astype(float)
    ids = np.arange(n) * 5
    out = mih.nearest(frame(spark, ids, x), F.col("vec_id") % 100 == 0, rows_per_block=700, queries_per_block=40, sample_size=1000).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 5 * n, 100):
        want = brute(ids, x, q, 10)
        assert len(got[q]) == 10 and [r for _, r in got[q]] == sorted(r for _, r in got[q])
        exact = {v: d for v, d in brute(ids, x, q, n)}
        assert all(abs(exact[v] - d) < 1e-12 for v, d in got[q])
        hits += len({v for v, _ in want} & {v for v, _ in got[q]})
        total += 10
    assert hits / total > 0.9


def test_ties_copies_and_few_rows(spark):
    x = np.vstack([np.ones((40, 8)), -np.ones((3, 8))])
    ids = np.arange(43)
    out = mih.nearest(frame(spark, ids, x), F.col("vec_id") == 0, k=50).orderBy("rank").collect()
    assert [r.vec_id for r in out] == list(range(1, 43)) and [r.rank for r in out] == list(range(1, 43))
    few = mih.nearest(frame(spark, ids, x), F.col("vec_id") == 41).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [40, 42, 0, 1, 2, 3, 4, 5, 6, 7]


def test_unusable_vectors_take_no_part(spark):
    good = [[float(i), 1.0, 2.0] for i in range(1, 6)]
    rows = [(i, v) for i, v in enumerate(good)] + [
        (10, None), (11, [0.0, 0.0, 0.0]), (12, [1.0, None, 1.0]), (13, [float("nan"), 1.0, 1.0]),
        (14, [float("inf"), 1.0, 1.0]), (15, [1.0, 2.0]), (16, []), (None, [1.0, 1.0, 2.0]), (2, [3.5, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("block", F.lit(2))
    out = mih.nearest(df, F.lit(True)).collect()
    assert {r.query_id for r in out} == {0, 1, 2, 3, 4} and {r.vec_id for r in out} == {0, 1, 2, 3, 4}
    assert all(r.query_id != r.vec_id for r in out)
    assert len([r for r in out if r.query_id == 0]) == 5                     # the repeated id twice
    assert mih.nearest(df.limit(0), F.lit(True)).count() == 0
    assert mih.nearest(df, F.lit(False)).count() == 0
