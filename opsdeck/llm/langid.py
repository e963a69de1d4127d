"""Language identification by string-kernel classification.

Kernel: a blended spectrum of character 1-, 2- and 3-grams. A text is the set of n-grams that
occur in its letters (other characters are word borders), hashed to a fixed number of places
per n; two texts' kernel is the sum over n of |common places| / sqrt(|places| * |places|).
Learning: Nystroem features from landmark texts, then one-versus-rest ridge regression on
them. The kernel is a product of scaled presence vectors, so landmarks, Nystroem map and
regression weights multiply into one matrix of places x languages, and a block of texts is
scored by one matrix product.

The training rows are a bounded sample: per language the ``TRAIN_PER_LANGUAGE`` rows with the
smallest hash of id, text and place in the table, so rows without an id, or that share one, or
repeat, are drawn like any others. What reaches the driver are their presence bits, of fixed size.
Every language has a landmark.

Defined results: a null text or one without letters gets ``und`` with score 0, as does every
text when there is nothing to learn from. Ties go to the language first in order. Repeated
rows get equal results; no row is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsdeck.llm.common import fresh

#: Places per n-gram length, the first for single characters.
PLACES = (1024, 4096, 16384)
DIMS = sum(PLACES)
TRAIN_PER_LANGUAGE = 300
LANDMARKS = 160
MAX_LANGUAGES = 256
MAX_TRAIN = 20_000  # over all languages
RIDGE = 1e-2
BLOCK = 64
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def presence(texts: list[str | None]) -> np.ndarray:
    """Which places occur in each text, as a boolean matrix."""
    out = np.zeros((len(texts), DIMS), dtype=bool)
    for row, text in zip(out, texts, strict=True):
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[code]
        if not letter.any():
            continue
        code = np.where(letter, code, np.uint32(32))
        keep = letter.copy()  # of a run of other characters the first stands for the border
        keep[1:] |= letter[:-1]
        code = code[keep]
        end = [] if code[-1] == 32 else [np.uint32(32)]
        code = np.concatenate(([np.uint32(32)], code, end)).astype(np.uint32)
        mixed, first = np.zeros(len(code), dtype=np.uint32), 0
        for n, places in enumerate(PLACES):
            mixed = (mixed[: len(code) - n] if n == 0 else mixed[:-1]) * _MULTIPLIERS[1] + code[n:] * _MULTIPLIERS[0]
            mixed ^= mixed >> np.uint32(15)
            at = (mixed * _MULTIPLIERS[2]) >> np.uint32(32 - places.bit_length() + 1)
            row[first + at] = True
            first += places
    return out


def scaled(present: np.ndarray) -> np.ndarray:
    """Presence divided by the root of the number of places of the same n."""
    x, first = present.astype(np.float32), 0
    for places in PLACES:
        part = x[:, first:first + places]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1.0))
        first += places
    return x


def solve(present: np.ndarray, label: np.ndarray, n_labels: int, landmarks: int = LANDMARKS,
          ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights (places x languages) and offsets of the regression.

    Landmarks are taken from the languages in turn.
    """
    x = scaled(present).astype(np.float64)
    turn = np.zeros(len(label), dtype=np.int64)
    for c in range(n_labels):
        turn[label == c] = np.arange((label == c).sum())
    marks = x[np.lexsort((label, turn))[:landmarks]]
    value, vector = np.linalg.eigh(marks @ marks.T)
    good = value > 1e-8 * value.max()
    nystroem = vector[:, good] / np.sqrt(value[good])  # kernels to the landmarks -> features
    feature = x @ marks.T @ nystroem
    target = (label[:, None] == np.arange(n_labels)).astype(np.float64)
    mean, target_mean = feature.mean(axis=0), target.mean(axis=0)
    centred = feature - mean
    gram = centred.T @ centred
    gram[np.diag_indices_from(gram)] += ridge * max(len(x), 1) / 100
    weight = np.linalg.solve(gram, centred.T @ (target - target_mean))
    return marks.T @ (nystroem @ weight), target_mean - mean @ weight


def training_rows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """Of each language the rows with the smallest hash. A language's share is cut by the hash
    first, so the window sees about twice the rows it keeps."""
    counts = labelled.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    per_language = min(per_language, MAX_TRAIN // max(1, len(counts)))
    hashed, rank = fresh(labelled, "hashed"), fresh(labelled, "rank")
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(lang_col) == r[lang_col], F.lit(min(1.0, (2.0 * per_language + 50) / r["count"]))).otherwise(share)
    rows = labelled.withColumn(hashed, F.xxhash64(id_col, text_col, F.monotonically_increasing_id()))
    rows = rows.filter(F.pmod(F.col(hashed), F.lit(1 << 40)) < share * float(1 << 40))
    order = Window.partitionBy(lang_col).orderBy(hashed, id_col)
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= per_language).drop(rank, hashed)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS):
    """Languages in order, weights and offsets; no languages if there is nothing to learn from."""
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        id_col, text_col, F.col(lang_col).cast("string").alias(lang_col))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                packed = np.packbits(presence(part.column(1).to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([p.tobytes() for p in packed], pa.binary())],
                                                 names=["id", "lang", "bits"])

    sample = training_rows(labelled, id_col, text_col, lang_col, per_language)
    kind = dict(sample.dtypes)[id_col]
    rows = sample.mapInArrow(bits, f"id {kind}, lang string, bits binary").orderBy("lang", F.xxhash64("id"), "bits").collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return [], np.zeros((DIMS, 0)), np.zeros(0)
    present = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in rows]), axis=1)[:, :DIMS].astype(bool)
    label = np.array([languages.index(r["lang"]) for r in rows])
    return languages, *solve(present, label, len(languages), max(landmarks, len(languages)))


def predict(docs: DataFrame, model, *, text_col: str = "text", lang_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score from 0 to 1 (columns of those names
    are replaced)."""
    languages, weight, offset = model
    held = docs.sparkSession.sparkContext.broadcast((languages, weight.astype(np.float32), offset))

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, w, b = held.value
        for batch in batches:
            lang, score = [], []
            for at in range(0, len(batch), BLOCK):
                present = presence(batch.slice(at, BLOCK).to_pylist())
                known = present.any(axis=1) & bool(names)
                value = scaled(present) @ w + b if names else np.zeros((len(present), 1))
                best = value.argmax(axis=1)
                lang += [names[i] if k else "und" for i, k in zip(best, known, strict=True)]
                score += np.where(known, np.clip(value.max(axis=1), 0.0, 1.0), 0.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    found = fresh(docs, "found")
    out = docs.withColumn(found, run(F.col(text_col)))
    return out.withColumn(lang_col, F.col(found)["lang"]).withColumn(score_col, F.col(found)["score"]).drop(found)


def query(spark, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 4 is not 2, predicts all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")
