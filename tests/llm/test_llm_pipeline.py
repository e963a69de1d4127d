import random

import corpus_pipeline
import pytest
from llm_helpers import SCHEMA
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.random():.12f}"[:9] for _ in range(n)]
    base, passage = fresh(120), fresh(60)
    near = list(base)
    near[50] = "changed"
    texts = {0: fresh(200), 1: base, 2: near, 3: base, 4: fresh(80) + passage, 5: passage + fresh(90), 6: fresh(30), 7: ["bad", "words"] * 200,
             8: fresh(300)}
    rows = [(i, " ".join(t), "en", f"s{i % 2}", len(" ".join(t))) for i, t in texts.items()] + [(9, None, None, None, None), (10, "", "en", "s0", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_each_stage_does_its_part(spark, corpus, tmp_path):
    docs, seen = corpus, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == corpus.dtypes
    ids = lambda name: sorted(r.doc_id for r in seen[name].collect())
    assert ids("quality rules") == [0, 1, 2, 3, 4, 5, 8]
    assert ids("n-gram Jaccard join") == [0, 1, 4, 5, 8]
    cut = {r.doc_id: r for r in seen["substring dedup"].collect()}
    assert {i: len(r.text.split()) for i, r in cut.items()} == {0: 200, 1: 120, 4: 80, 5: 90, 8: 300}
    assert all(r.n_chars == len(r.text) for r in cut.values())
    mixed = seen["mixing sources"]
    assert set(ids("mixing sources")) <= set(cut) and mixed.count() == seen["byte-level BPE"].count()
    from opsdeck.llm import bpe
    encoding = bpe.load(*bpe.production_vocabulary())
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert all(encoding.decode(r.token_ids) == text[r.doc_id] for r in seen["byte-level BPE"].collect())


def test_repeated_rows_null_ids_and_shared_ids(spark, tmp_path):
    rng = random.Random(12)
    twice, none, copied, alone, last = (" ".join(f"w{rng.random():.12f}"[:9] for _ in range(80)) for _ in range(5))
    rows = [(1, twice), (1, twice), (None, none), (None, none), (None, copied), (2, copied), (3, copied), (3, alone), (4, last)]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in rows], SCHEMA).repartition(4)
    stages = dict(corpus_pipeline.STAGES)
    for k, name in enumerate(["n-gram Jaccard join", "substring dedup"]):
        stages[name](spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        found = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        assert found == sorted([(1, twice), (None, none), (2, copied), (3, alone), (4, last)], key=str)


def test_last_stage_decodes_what_it_encodes(spark, corpus):
    docs = corpus.unionByName(spark.createDataFrame([(11, "ÄÖ \n日本 x", "en", "s0", 8)], SCHEMA))
    out = dict(corpus_pipeline.STAGES)["byte-level BPE"](spark, docs, SF)
    assert out.columns == ["doc_id", "lang", "source", "token_ids", "decoded"]
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id: bytes(r.decoded) for r in out.collect()} == text


def test_empty_table(spark, corpus):
    docs = corpus.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
    assert docs.columns == corpus.columns


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() > 50
    assert out.filter(F.size("token_ids") > 0).count() > 0.9 * out.count()
