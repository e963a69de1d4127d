import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import make_docs, noisy_texts, with_clashes
from pyspark.sql import functions as F

from opsdeck.llm import phrases


def brute(rows, min_count, max_words=4, first=2000, absorb=80, scale=2_000_000):
    """rows: (lang, text); the rows of ``collocations`` as tuples."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n\v\f\r]", text):
            w = tuple(x for x in re.split(r"[ \t]+", piece) if x)
            n[lang] += len(w)
            f.update((lang, w[i:i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    gone = {(lang, w[i:i + m]) for (lang, w), a in cand.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)
            if 100 * a >= absorb * cand[lang, w[i:i + m]]}
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            cuts = [(scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, le, r) in enumerate(sorted(rows)[:first])}


def result(df):
    rows = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=150, vocabulary=30):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["É", "Ab", "aB", "日本"]
    fixed = [[rng.choice(vocab) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        while len(words) < rng.randint(0, 50):
            words += rng.choice(fixed) if rng.random() < 0.5 else [rng.choice(vocab)]
        text = "".join(w + rng.choice([" "] * 12 + ["\t", ". ", ",", "\n", "\r\n", "  ", "!?"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return [*rows, ("en", None), ("en", ""), (None, " . ,"), ("fr", "one two")]


@pytest.mark.parametrize("seed,min_count,max_words,sample_bytes,chunk_bytes", [
    (1, 3, 4, 1 << 30, 1 << 20), (2, 4, 4, 400, 700), (3, 3, 3, 1, 1), (4, 5, 2, 2000, 3000), (5, 2, 5, 300, 2000)])
def test_against_brute_force(spark, seed, min_count, max_words, sample_bytes, chunk_bytes):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for name in ("key", "chunk", "n", "phrase", "a"):
        docs = docs.withColumn(name, F.lit("clash"))
    options = {"min_count": min_count, "max_words": max_words, "sample_bytes": sample_bytes, "chunk_bytes": chunk_bytes}
    assert result(phrases.collocations(docs, **options)) == brute(rows, min_count, max_words)


def test_border_failures_lead_to_expansion_until_closed(spark):
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    _, known, none = phrases.mine(docs, min_count=3, chunk_bytes=2000)
    assert none == 0                                                     # the sample is the whole table
    _, again, several = phrases.mine(docs, min_count=3, chunk_bytes=2000, sample_bytes=1)
    assert 1 <= several <= 4                                             # the sample is empty: all but the words come later
    pick = lambda df: sorted((r.chunk, r.key, r.total, r.own) for r in df.collect())
    assert pick(known) == pick(again) and {r["pass"] for r in again.collect()} >= {0, 1, 2}


def test_first_of_each_language_ties_and_absorbed(spark):
    rows = [("en", "a b c. " * 10 + "b c. " * 2 + "x y. y x. " * 10), ("de", "p q r s. " * 8)]
    docs = spark.createDataFrame(rows * 2, "lang string, text string")
    assert result(phrases.collocations(docs, min_count=5, first=3)) == brute(rows * 2, 5, first=3)
    assert result(phrases.collocations(docs, min_count=5, absorb_percent=100)) == brute(rows * 2, 5, absorb=100)
    assert phrases.collocations(docs.limit(0)).count() == 0
    noisy = with_clashes(make_docs(spark, noisy_texts(3, n=60)))
    assert result(phrases.collocations(noisy, min_count=4)) == brute([(r.lang, r.text) for r in noisy.collect()], 4)


def test_a_very_long_text_and_one_hot_language(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["hot", "pair", "of", "words", f"u{rng.random()}"]) for _ in range(60_000))
    rows = [("en", long)] + [("en", "hot pair of words and more")] * 300 + [("de", "hot pair")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert result(phrases.collocations(docs, sample_bytes=5000, chunk_bytes=4000)) == brute(rows, 30)


def test_scores_beyond_64_bits():
    a, both = np.array([2 ** 44, 5]), np.array([2 ** 45 + 3, 20])
    assert phrases._score(a, both, 2_000_000).tolist() == [2_000_000 * 2 ** 44 // (2 ** 45 + 3), 500_000]


def test_phrases_travel_packed_and_expansion_looks_beside_new_ones_only(spark):
    docs = spark.createDataFrame(corpus(6), "lang string, text string").coalesce(2)
    chunks, known, number = phrases._mined(docs, min_count=3, chunk_bytes=2000, sample_bytes=1)
    rows = phrases._unpacked(known)
    assert number >= 1 and known.count() <= chunks.count() * (number + 1) < rows.count()      # one bucket: a row per chunk and pass
    assert sum(r.missed for r in known.collect()) == rows.filter("not proposed").count()
    # what has only proposed parts was counted by the first pass: a pass beside none but such counts nothing
    expand = phrases._expansion(1, 4, 1)
    text = chunks.toArrow().slice(0, 1)
    have = known.filter(f"pass = 0 and chunk = {text['chunk'][0].as_py()}").toArrow()
    ones = have.set_column(have.schema.get_field_index("proposed"), "proposed", pa.array([b"\xff" * len(x.as_py()) for x in have["proposed"]], pa.binary()))
    assert expand(text, have).num_rows and not expand(text, ones).num_rows


def test_numbers_are_packed_in_as_few_bytes_as_they_need():
    for most, size in ((255, 1), (256, 2), (2 ** 16, 4), (2 ** 40, 8)):
        n = np.array([1, most, 7])
        blob = phrases._pack(n)
        assert len(blob) == 3 * size and phrases._unpack(blob, 3).tolist() == n.tolist()
    assert phrases._unpack(phrases._pack(np.zeros(0, dtype=np.int64)), 0).tolist() == []


def test_memory_of_a_chunk_is_bounded_by_its_words():
    rng = random.Random(9)
    text = " ".join(f"w{int(rng.paretovariate(0.5)) % 50_000}" for _ in range(200_000)).encode()

    def peak(run):
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    words, _ = peak(lambda: phrases.Pieces([text], ["en"]))
    n = len(words.hashes)
    assert n == 200_000
    at = np.arange(n - 3)
    found, most = peak(lambda: phrases.Counted.of(words, at, 4))
    assert most < 80 * n                                                  # no tables of powers, no number for each place
    assert (np.sort(found.places) == at).all() and (np.repeat(found.keys, found.n) == words.names(found.places, 4)).all()
    assert (words.names(found.first, 4) == found.keys).all() and (found.first == found.places[np.cumsum(found.n) - found.n]).all()
    every = [phrases.Counted.of(words, np.flatnonzero(words.together(k)), k) for k in (1, 2, 3, 4)]
    order = np.argsort(keys := np.concatenate([c.keys for c in every]))
    totals = np.concatenate([c.n for c in every])[order]
    (level, total), most = peak(lambda: phrases._known(words, keys[order], np.zeros(len(keys), np.int8), totals, 4))
    assert most < 90 * n
    for k, c in enumerate(every, 1):
        assert (level[k][c.places] == 0).all() and (total[k][c.places] == np.repeat(c.n, c.n)).all()
