import random
from itertools import combinations

import numpy as np
import pytest
from llm_helpers import make_docs, noisy_texts, with_clashes, words
from pyspark.sql import functions as F

from opsdeck.llm import exchange, ngram_join
from opsdeck.llm.components import connected


def grams(text, n):
    w = words(text, lower=True)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, n, percent):
    sets, root = [grams(t, n) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed,n,percent,vocabulary", [(1, 5, 75, 60), (2, 2, 75, 8), (3, 3, 50, 10), (4, 1, 60, 15), (5, 2, 100, 6)])
def test_against_brute_force(spark, seed, n, percent, vocabulary):
    texts = noisy_texts(seed, n=70, vocabulary=vocabulary, longest=30)
    docs = with_clashes(make_docs(spark, texts))
    out = ngram_join.near_duplicates(docs, n=n, percent=percent, sizes=exchange.Layout(5, 4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(texts, n, percent)


def test_chains_and_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for _ in range(60):                    # near copies of one text
        copy = list(base)
        copy[rng.randrange(60)] = f"n{rng.random()}"
        texts.append(" ".join(copy))
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[k:k + 100]) for k in range(0, 100, 8)]     # each like the next only
    texts += [" ".join(base)] * 20
    out = ngram_join.near_duplicates(make_docs(spark, texts), sizes=exchange.Layout(6, 3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == brute(texts, 5, 75) and len({c for _, c in got.values()}) == 2
    kept = ngram_join.keep_one(make_docs(spark, texts), sizes=exchange.Layout(6, 3))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 60] and kept.columns == make_docs(spark, texts).columns


def test_edges(spark):
    docs = make_docs(spark, [None, "", " ", "A b", "a B", "a b c d e", "a b c d", "A B C D"])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 6), 7: (1, 6)}
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    rows = ngram_join.near_duplicates(nameless).collect()
    assert len(rows) == 8 and all(r.component_id == r.doc_id for r in rows)
    twice = ngram_join.near_duplicates(docs.union(docs))
    assert twice.count() == 16 and twice.distinct().count() == 8


def test_tree_finds_all_similar_sets():
    rng = random.Random(7)
    pool = list(range(100, 140))
    sets = [sorted(rng.sample(pool, rng.randint(3, 30))) for _ in range(200)]
    rows = sorted((np.array(s, dtype=">u8").tobytes(), s, len(s), i) for i, s in enumerate(sets))
    tree = ngram_join.Tree(rows)
    for percent in (30, 60, 75, 100):
        for s in sets[:60]:
            found = []
            tree.probe(frozenset(s), len(s), percent, found)
            want = [i for i, o in enumerate(sets) if 100 * len(set(s) & set(o)) >= percent * len(set(s) | set(o))]
            assert sorted(found) == want


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1300)] + [
        (rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b and all(a not in l or l == (a, b) for l in links)}
    assert got == {x: top(x) for x in root if x not in alone}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_repeat_hot_nodes_only(spark, monkeypatch):
    links = [(0, k) for k in range(1, 2001)] + [(3 * k, 3 * k + 1) for k in range(1000, 2000)] + [(3 * k + 1, 3 * k + 2) for k in range(1000, 2000)]
    df, repeated = spark.createDataFrame(links, "a long, b long"), []
    hint = type(df).hint
    monkeypatch.setattr(type(df), "hint", lambda self, name: repeated.append(self.count()) or hint(self, name))
    got = {r.node: r.label for r in connected(df).collect()}
    assert got == {k: 0 for k in range(2001)} | {k: k // 3 * 3 for k in range(3000, 6000)}
    # a row per node, 16 for the node with half of all links
    assert len(repeated) >= 2 and max(repeated) == 5001 + 15


def test_probes_meet_a_place_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    texts = noisy_texts(6, n=80, vocabulary=9, longest=30)
    docs, want = make_docs(spark, texts), brute(texts, 2, 60)
    out = ngram_join.near_duplicates(docs, n=2, percent=60, sizes=exchange.Layout(2, 2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    rows = [(k % 2, i, 20, bytes(160)) for k, i in enumerate(range(100))]
    sets = spark.createDataFrame(rows, "place long, class_id long, n_shingles long, grams binary")
    visits = sets.select("class_id").crossJoin(sets.select("place").distinct())
    dealt = ngram_join._probes(sets, visits)[0].groupBy("place", "block").agg(F.sum(F.octet_length("probe_grams")).alias("n")).collect()
    assert sum(r.n for r in dealt) == 200 * 160 and len(dealt) == 16 and max(r.n for r in dealt) < 3 * 2000


def test_boilerplate_too_short_for_a_link_brings_no_probes(spark, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.random():.12f}"[:9] for _ in range(n)]
    common, seen, second = fresh(60), [], ngram_join._second
    texts = [" ".join(fresh(14) + common) for _ in range(30)]
    monkeypatch.setattr(ngram_join, "_second", lambda *a: seen.append(second(*a).count()) or second(*a))
    out = ngram_join.near_duplicates(make_docs(spark, texts), sizes=exchange.Layout(5, 3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(texts, 5, 75) and seen == [0]


def test_a_deep_tree_needs_no_recursion():
    rng, n = random.Random(9), 3000
    base = list(range(10_000, 10_000 + n))
    rows = []
    for i in range(n):                       # each leaves the common path one n-gram later
        seq = base[:i] + [i] + base[i:i + 3]
        rows.append((np.array(seq, dtype=np.uint64).tobytes(), seq, len(seq), i))
    tree = ngram_join.Tree(sorted(rows))
    for i in rng.sample(range(n), 5):
        found = []
        tree.probe(frozenset(rows[i][1]), len(rows[i][1]), 100, found)
        assert found == [i]


def test_near_copies_lie_together_and_are_probed_once(spark, monkeypatch):
    """A group of near copies that are not all like one another: probes grow with its members."""
    rng = random.Random(10)
    base = [f"b{k}" for k in range(400)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.choice([1, 6, 10])):
            copy[rng.randrange(400)] = f"n{rng.random()}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"u{rng.random()}" for _ in range(50)) for _ in range(30)]
    visits, probes = [], ngram_join._probes
    monkeypatch.setattr(ngram_join, "_probes", lambda sets, v: visits.append(v.count()) or probes(sets, v))
    out = ngram_join.near_duplicates(make_docs(spark, texts), sizes=exchange.Layout(40, 5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(texts, 5, 75)
    assert sum(visits) < 3 * 120             # 40 chunks would have made up to 120 x 40


def test_boilerplate_of_a_third_of_all_documents(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.random():.12f}"[:9] for _ in range(n)]
    common = fresh(40)
    own = [fresh(30) for _ in range(30)]
    texts = [" ".join(own[k % 30][: 30 - k // 30] + common) for k in range(90)] + [" ".join(fresh(60)) for _ in range(180)]
    out = ngram_join.near_duplicates(make_docs(spark, texts), sizes=exchange.Layout(9, 4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(texts, 5, 75)
