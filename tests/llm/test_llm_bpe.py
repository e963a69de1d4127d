import random
from hashlib import sha256

import pytest
from llm_helpers import make_docs, noisy_texts
from pyspark.sql import functions as F

from opsdeck.llm import bpe

RANKS, PATTERN = bpe.production_vocabulary()


def odd_texts(n=300):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "'s", "'ll", "'", "a", "the", "Zürich", "日本", "12", "²", "é", "!", "...", "😀", " ", "<|endoftext|>", "q" * 90]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 3, 17, 100])
def test_pieces_change_nothing(most):
    encoding = bpe.load(RANKS, PATTERN)
    for text in odd_texts():
        assert "".join(bpe.pieces(text, most)) == text
        assert bpe.encode_text(text.encode(), encoding, most) == encoding.encode_ordinary(text)


def test_round_trip_and_digests(spark):
    texts = [None, "", *odd_texts(60), "long text, " * 20_000, *noisy_texts(1)]
    docs = make_docs(spark, texts).withColumn("token_ids", F.lit("clash"))
    coded = bpe.encode_documents(docs, RANKS, PATTERN, piece_chars=1000)
    back = coded.withColumn("raw", bpe.decode(F.col("token_ids"), RANKS, PATTERN)).withColumn(
        "digest", bpe.round_trip(F.col("text"), RANKS, PATTERN))
    encoding = bpe.load(RANKS, PATTERN)
    rows = back.collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert r.token_ids == ids and bytes(r.raw) == text.encode()
        assert tuple(r.digest) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())
    assert bpe.encode_documents(docs.limit(0), RANKS, PATTERN).count() == 0


def test_repeated_rows_and_bad_bytes(spark):
    docs = make_docs(spark, ["same"]).select("doc_id", "text")
    assert bpe.encode_documents(docs.union(docs), RANKS, PATTERN).count() == 2
    bad = spark.createDataFrame([(bytearray(b"a\xffb"),)], "text binary")
    row = bad.select(bpe.decode(bpe.encode(F.col("text"), RANKS, PATTERN), RANKS, PATTERN).alias("raw")).first()
    assert bytes(row.raw).decode() == "a�b"
