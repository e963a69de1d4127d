import random

import pytest
from llm_helpers import make_docs, noisy_texts, with_clashes, words

from opsdeck.llm import quality


def brute(text, least):
    w = words(text)
    n, lines, dup = len(w), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    rep = [False] * n
    for i in range(n - 2):
        if sum(w[j:j + 3] == w[i:i + 3] for j in range(n - 2)) > 1:
            rep[i:i + 3] = [True] * 3
    longest, cover = 0, [False] * n
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        longest = max(longest, best)
        if best >= least:
            cover[i:i + best] = [True] * best
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(rep), sum(cover), longest)


@pytest.mark.parametrize("seed,vocabulary,least", [(1, 3, 2), (2, 8, 3), (3, 2, 5), (4, 30, 2)])
def test_against_brute_force(seed, vocabulary, least):
    texts = noisy_texts(seed, n=30, vocabulary=vocabulary, longest=50) + ["a b\na b\n \nc\na b", "#*$ %&|<> é$\n#*$ %&|<> é$"]
    raw = [None if t is None else t.encode() for t in texts]
    found = quality.measure(raw, least)
    assert list(zip(*(found[f].tolist() for f in quality._FIELDS), strict=True)) == [brute(t, least) for t in texts]
    alone = [quality.measure([r], least) for r in raw]
    assert [tuple(int(m[f][0]) for f in quality._FIELDS) for m in alone] == [brute(t, least) for t in texts]


def test_verdicts(spark):
    rng = random.Random(2)
    clean = [f"{rng.random()}" for _ in range(300)]
    passage = clean[:60]
    texts = [" ".join(clean), " ".join(clean[:49]), " ".join(["again and"] * 200), " ".join((clean[:40] + passage) * 2),
             " ".join(clean + clean[:30]), None, ""]
    docs = with_clashes(make_docs(spark, texts))
    got = {r.doc_id: r.quality for r in quality.with_quality(docs).collect()}
    assert [got[i].kept for i in range(7)] == [True, False, False, False, True, False, False]
    assert [got[i].base_failed for i in range(7)] == [False, True, True, True, False, True, True]
    method = quality.with_quality(docs, max_covered_percent=5).filter("doc_id = 4").first().quality
    assert not method.base_failed and not method.kept and method.covered_words == 60 and method.longest_repeat == 30
    assert quality.with_quality(docs, max_longest=29).filter("doc_id = 4").first().quality.kept is False
    assert quality.with_quality(docs.limit(0)).count() == 0
    assert quality.with_quality(docs.union(docs)).count() == 14


def test_very_long_text():
    text = ("unit of words " * 40_000).encode()
    found = quality.measure([text, b"x"])
    assert found["n_words"][0] == 120_000 and found["longest_repeat"][0] == 119_997 and found["covered_words"][0] == 120_000
