"""Small document tables for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = "chunk__ string, chunk int, bucket string, note string, row string, raw string, copy string, spans string, n_words string"


def words(text, lower=False):
    if lower:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[ \t\n\v\f\r]+", text or "") if w]


def make_docs(spark, texts, parts=3):
    """Documents 0.. with these texts; every second without language."""
    rows = [(i, t, None if i % 2 else "en", f"s{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def noisy_texts(seed, n=40, vocabulary=12, longest=60):
    """Random texts of few words (so that much repeats), with nulls, empties, copies and odd blanks."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["É", "ÄB", "日本", "Ab", "x" * 300]
    blanks = [" ", "  ", "\n", "\t", "\r\n", "\v", "\f"]
    texts = [None, "", "   \n", "one", "two words"]
    while len(texts) < n:
        if texts and rng.random() < 0.25 and texts[-1]:
            base = words(texts[rng.randrange(5, len(texts))]) if len(texts) > 6 else words(texts[-1])
            for _ in range(rng.randint(0, 3)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(vocab)
        else:
            base = [rng.choice(vocab) for _ in range(rng.randint(1, longest))]
        texts.append("".join(w + rng.choice(blanks) for w in base))
    return texts


def with_clashes(df):
    from pyspark.sql import functions as F
    for spec in CLASHES.split(", "):
        name, kind = spec.split(" ")
        df = df.withColumn(name, F.lit("7").cast(kind))
    return df
