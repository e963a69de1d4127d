import hashlib
import random
import re

import numpy as np
import pytest
from llm_helpers import make_docs, noisy_texts, with_clashes
from pyspark.sql import functions as F

from opsdeck.llm import fim


def brute(doc_id, text, fim_percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(2)
    return noisy_texts(1, n=60) + ["\n", "\n\n\n", "no break", "ends\n", "\nbegins", "a<P>\nb", "<S>", "x<M", "<M>\n", "日本\n語\n\r\nÄ B\x85C\n",
                                   "".join("z" * int(rng.expovariate(0.01)) + "\n" for _ in range(3000)), "w " * 300_000 + "\n" + "é\n" * 50_000]


@pytest.mark.parametrize("fim_percent,spm_percent", [(100, 50), (60, 0), (0, 50)])
def test_against_brute_force(spark, fim_percent, spm_percent):
    docs = with_clashes(make_docs(spark, texts())).withColumn("fim", F.lit(1)).withColumn("n", F.lit(2)).withColumn("form", F.lit("f"))
    out = fim.fill_in_middle(docs, fim_percent=fim_percent, spm_percent=spm_percent)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output) for r in out.collect()}
    assert got == {i: brute(i, t, fim_percent, spm_percent) for i, t in enumerate(texts())}


def test_round_trip(spark):
    out = fim.fill_in_middle(make_docs(spark, texts()))
    rows = out.withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert all(r.back == (r.text or "") for r in rows) and {r.fim.form for r in rows} == {"plain", "psm", "spm"}


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a\nb\nc"), (None, "a\nb\nc"), (5, None), (5, None), (7, "x\n")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, *r.fim[:5]) for r in fim.fill_in_middle(docs).collect())
    assert got == sorted((i or 0, *brute(i, t)) for i, t in [(None, "a\nb\nc")] * 2 + [(5, None)] * 2 + [(7, "x\n")])
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("max_error", [1, 10, 100, 1000])
def test_index_is_bounded_and_exact(max_error):
    rng = np.random.default_rng(max_error)
    for steps in (np.full(5000, 80), rng.integers(1, 200, 5000), rng.pareto(1.1, 5000).astype(int) + 1, np.array([], dtype=int),
                  np.repeat([1, 500, 3], [700, 2, 900]), np.array([1 << 40, 1, 1, 1 << 33])):
        offsets = np.concatenate(([0], np.cumsum(steps))).astype(np.int64)
        index = fim.RankIndex.fit(offsets, max_error)
        assert np.abs(index.residuals.astype(np.int64)).max() <= max_error + 1
        assert index.at(list(range(len(offsets)))) == offsets.tolist()
        again = fim.RankIndex.restored({k: v if k == "residuals" else list(v) for k, v in index.stored().items()}, max_error)
        assert again.at([0, len(offsets) - 1]) == [0, int(offsets[-1])]
    assert len(fim.RankIndex.fit(np.arange(0, 80 * 5001, 80), max_error).rank) == 1       # a straight line is one segment
    assert len(fim.RankIndex.fit(np.cumsum(np.ones(10 ** 6, dtype=np.int64)), 1).rank) == 1
