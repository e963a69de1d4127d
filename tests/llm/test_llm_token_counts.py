import random

import public_tokenizers
import pytest
from llm_helpers import make_docs, noisy_texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opsdeck.llm import token_counts as tc

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "\r", "'", "'s", "'re", "'r", "'ve", "'v", "'ll", "'l", "'d", "'S", "a", "the", "tion", "Ab", "1", "23",
            "²", "é", "ß", "日本", "😀", "!", "...", " ", "　", " ", "<|endoftext|>", "<|endo", "text|>", "\x1c", "\x85",
            "​", "aaaa", "A", "zq", "ü", "́", "\x00", "٣"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_whole_texts():
    m = tc.machine(FILE)
    for text in odd_texts(3000) + [t or "" for t in noisy_texts(1)]:
        assert m.total(text) == expected(text), text


def test_chunk_maps_compose():
    m = tc.machine(FILE)
    rng = random.Random(8)
    for text in odd_texts(1500, seed=9):
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(1, 6)))
        maps = [m.chunk_map(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        left = maps[0]
        for one in maps[1:]:
            left = m.compose(left, one)
        assert m.close(m.scan(maps)) == m.close(left) == expected(text)


def test_neighbours_are_those_of_the_definition():
    merges, rng = tc.machine(FILE).merges, random.Random(4)

    def by_definition(raw):
        parts = [bytes([b]) for b in raw]
        while len(parts) > 1:
            ranked = [(merges.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(ranked)
            if rank == 1 << 30:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    tokens = [t for t in merges.token if t]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert merges.beside(a, b) == (by_definition(a + b) == [a, b])


@pytest.mark.parametrize("chunk_bytes,spread", [(1, False), (7, True), (1 << 18, False)])
def test_documents(spark, chunk_bytes, spread):
    texts = [None, "", *odd_texts(80, seed=chunk_bytes), "many words of text " * 200]
    docs = make_docs(spark, texts).withColumn("row", F.lit("mine")).withColumn("chunk", F.lit(5)).withColumn("n_tokens", F.lit(-1))
    docs = docs.union(docs.filter("doc_id = 10"))
    out = tc.count_tokens(docs, FILE, chunk_bytes=chunk_bytes, spread=spread)
    rows = out.collect()
    assert len(rows) == len(texts) + 1 and "row" in out.columns
    assert all(r.n_tokens == expected(texts[r.doc_id]) and r.row == "mine" for r in rows)
    assert tc.count_tokens(docs.limit(0), FILE).count() == 0


def test_dropped_states_change_nothing(monkeypatch):
    monkeypatch.setattr(tc, "MAX_STATES", 50)
    monkeypatch.setattr(tc, "MAX_WORDS", 20)
    m = tc.machine(FILE)
    for text in noisy_texts(6, n=30, vocabulary=200):
        assert m.total(text or "") == expected(text)
