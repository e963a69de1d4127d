import numpy as np
from llm_helpers import make_docs
from pyspark.sql import functions as F

from opsdeck.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = langid.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_presence_is_the_set_of_grams():
    a, b, c = langid.presence(["abab", "ab--AB  ab!", None])
    assert a.any() and not c.any()
    assert (langid.presence(["ab ab"])[0] == b).all()                        # other characters are borders, case is folded
    k = langid.scaled(langid.presence(["abab", "abab", "xyz"]))
    kernel = k @ k.T
    assert np.isclose(kernel[0, 0], len(langid.PLACES)) and np.isclose(kernel[0, 1], kernel[0, 0]) and kernel[0, 2] < 2


def test_nystroem_scores_are_kernel_scores():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde " if i % 2 else "cdefg "), 60)) for i in range(40)]
    present, label = langid.presence(texts), np.arange(40) % 2
    weight, offset = langid.solve(present, label, 2, landmarks=40, ridge=1e-6)
    score = langid.scaled(present) @ weight + offset
    assert (score.argmax(axis=1) == label).all() and np.allclose(score.sum(axis=1), 1, atol=1e-3)


def test_edges(spark):
    docs = make_docs(spark, [None, "", "123 !!", "the cat and the dog " * 5000, "and the cat", "and the cat"])
    docs = docs.withColumn("found", F.lit(1)).withColumn("hashed", F.lit(2)).withColumn("rank", F.lit(3))
    learned = langid.fit(docs)
    out = {r.doc_id: r for r in langid.predict(docs, learned).collect()}
    assert learned[0] == ["en"] and [out[i].lang_pred for i in range(6)] == ["und"] * 3 + ["en"] * 3
    assert out[0].score == 0 and out[4].score == out[5].score and out[4].found == 1
    nothing = langid.fit(docs.filter("lang is null"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"),
                                    F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("lang"))
    rows = langid.training_rows(docs, "doc_id", "text", "lang", 100).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in rows} == {"hot": 100, "b": 100}


def test_rows_without_id_that_share_one_or_repeat_are_learned_from(spark):
    docs = spark.range(12_000).select(
        F.when(F.col("id") % 4 == 0, F.col("id")).when(F.col("id") % 4 == 1, 5).alias("doc_id"),
        F.element_at(F.array(F.lit("eins zwei drei"), F.lit("un deux trois"), F.lit("uno dos tres"), F.concat(F.lit("abc "), F.col("id"))),
                     (F.col("id") % 4 + 1).cast("int")).alias("text"),
        F.element_at(F.array(F.lit("de"), F.lit("fr"), F.lit("es"), F.lit("xx")), (F.col("id") % 4 + 1).cast("int")).alias("lang"))
    rows = langid.training_rows(docs, "doc_id", "text", "lang", 100).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in rows} == {"de": 100, "fr": 100, "es": 100, "xx": 100}
    wrong = langid.predict(docs, langid.fit(docs)).filter("lang <> lang_pred").count()
    assert wrong == 0


def test_more_languages_than_landmarks(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"),
                                  F.concat(F.lit("l"), F.col("id") % 12).alias("lang"),
                                  F.repeat(F.concat(F.chr(F.col("id") % 12 + 97), F.lit(" ")), 5).alias("text"))
    found = langid.predict(docs, langid.fit(docs, landmarks=3))
    assert found.filter("lang <> lang_pred").count() == 0


def grams(text, n):
    """The n-grams of a text's letters, lower case, other characters as one border."""
    plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in plain:
        plain = plain.replace("  ", " ")
    return {plain[i:i + n] for i in range(len(plain) - n + 1)}


def brute_kernel(a, b):
    return sum(len(grams(a, n) & grams(b, n)) / (len(grams(a, n)) * len(grams(b, n))) ** 0.5 for n in (1, 2, 3))


def test_against_plain_sets_and_dense_kernel_ridge_regression():
    rng = np.random.default_rng(5)
    alphabets = ("abcde fg", "cdefg hé", "fghijk 日本")
    texts = ["".join(rng.choice(list(alphabets[i % 3]), 40)) + "!" for i in range(45)]
    train, test, label = texts[:30], texts[30:], np.arange(30) % 3
    kernel = np.array([[brute_kernel(a, b) for b in train] for a in train])
    ours = langid.scaled(langid.presence(train)).astype(float)
    assert np.abs(ours @ ours.T - kernel).max() < 0.1  # of 3 at most; measured 0.066, since places are hashed
    middle = np.eye(30) - 1 / 30
    target = (label[:, None] == np.arange(3)).astype(float)
    alpha = np.linalg.solve(middle @ kernel @ middle + 0.5 * 30 / 100 * np.eye(30), target - target.mean(axis=0))
    between = np.array([[brute_kernel(a, b) for b in train] for a in test])
    want = (between - kernel.mean(axis=0)) @ middle @ alpha + target.mean(axis=0)
    weight, offset = langid.solve(langid.presence(train), label, 3, landmarks=30, ridge=0.5)
    got = langid.scaled(langid.presence(test)) @ weight + offset
    assert np.abs(got - want).max() < 0.05 and (got.argmax(axis=1) == want.argmax(axis=1)).all()
