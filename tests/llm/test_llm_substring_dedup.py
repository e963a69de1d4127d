import random
from collections import Counter

import pytest
from llm_helpers import make_docs, noisy_texts, with_clashes, words
from pyspark.sql import functions as F

from opsdeck.llm import exchange, substring_dedup
from opsdeck.llm.words import Texts


def brute(texts, window):
    seqs = [words(t) for t in texts]
    count = Counter(tuple(s[i:i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if count[tuple(s[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(s), sum(gone), " ".join(w for w, g in zip(s, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("seed,window,block", [(1, 5, None), (2, 4, 2), (3, 7, 3), (4, 3, 1)])
def test_against_brute_force(spark, seed, window, block):
    texts = noisy_texts(seed, n=50, vocabulary=40)
    docs = with_clashes(make_docs(spark, texts)).drop("spans", "n_words")
    out = substring_dedup.repeated_words(docs, window=window, block=block, sizes=exchange.Layout(4, 3))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out.collect()}
    assert got == dict(enumerate(brute(texts, window)))
    assert set(docs.columns) | {"n_words", "n_removed", "spans"} == set(out.columns)
    for r in out.collect():
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed
        assert all(s.end - s.begin >= window for s in r.spans)


def test_shared_passage_goes_everywhere_and_other_words_stay(spark):
    rng = random.Random(0)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    passage = fresh(51)
    texts = [" ".join(fresh(40) + passage[:51] + fresh(30)) for _ in range(30)] + [" ".join(fresh(200))] * 2 + [" ".join(fresh(100))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeated_words(make_docs(spark, texts)).collect()}
    assert [got[i] for i in range(33)] == [51] * 30 + [200] * 2 + [0]


def test_inside_one_text_and_long_words(spark):
    unit = [f"v{k}" for k in range(40)]
    texts = [" ".join(unit + ["sep"] + unit), "y" * 3_000_000 + " tail", " ".join(["same"] * 36), " ".join(["same"] * 35)]
    got = {r.doc_id: (r.n_removed, r.n_words) for r in substring_dedup.repeated_words(make_docs(spark, texts)).collect()}
    assert got == {0: (80, 81), 1: (0, 2), 2: (36, 36), 3: (35, 35)}


def test_empty_table_nulls_and_repeated_rows(spark):
    docs = make_docs(spark, [None, "", " \n "])
    assert substring_dedup.repeated_words(docs.limit(0)).count() == 0
    assert [(r.n_words, r.n_removed, r.text, r.spans) for r in substring_dedup.repeated_words(docs).collect()] == [(0, 0, "", [])] * 3
    long = make_docs(spark, [" ".join(f"t{k}" for k in range(50))]).withColumn("doc_id", F.lit(None).cast("long"))
    twice = substring_dedup.repeated_words(long.union(long)).collect()
    assert [(r.n_removed, r.text) for r in twice] == [(50, "")] * 2
    with pytest.raises(ValueError):
        substring_dedup.repeated_words(docs, window=35, block=19)


def test_word_splitting_in_blocks(monkeypatch):
    from opsdeck.llm import words as w
    texts = [t for seed in range(4) for t in noisy_texts(seed)]
    whole = Texts(texts)
    monkeypatch.setattr(w, "_BLOCK", 64)
    parts = Texts(texts)
    assert (whole.hashes == parts.hashes).all() and (whole.starts == parts.starts).all() and (whole.ends == parts.ends).all()
    flat = [x.encode() for t in texts for x in words(t)]
    assert [bytes(whole.buf[a:b]) for a, b in zip(whole.starts, whole.ends, strict=True)] == flat
    assert len(set(whole.hashes.tolist())) == len(set(flat))
