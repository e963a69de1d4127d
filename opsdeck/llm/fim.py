"""Fill-in-the-middle: documents cut at two line boundaries, with a learned index of the boundaries.

A text of n lines has n + 1 boundaries, at known code point offsets. The index is a function from a
boundary's rank to its offset: a few straight segments, each fitted (by narrowing a cone of slopes
from its first boundary) to as many boundaries as it predicts within ``max_error`` code points, and
the small difference between prediction and truth for every boundary. A cut is looked up by
predicting it and adding that residual, which gives its exact offset; the lines themselves are not
kept. Segments and residuals are returned, so that other cuts of the text need no second split.

Which boundaries a document is cut at, and whether its parts are put in the order prefix, suffix,
middle (``psm``) or suffix, prefix, middle (``spm``), follows from a hash of its id alone.

Defined results: a null text counts as empty; an empty text, one that contains a marker, and one
that the rate leaves alone stay as they are (``plain``); a text without a line break has two
boundaries, its ends; a null id draws as an empty one; rows that repeat get equal results. Texts
are cut whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50
MARKERS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
MAX_ERROR = 100
_INDEX = pa.struct([("rank", pa.list_(pa.int64())), ("offset", pa.list_(pa.int64())), ("slope", pa.list_(pa.float64())),
                    ("residuals", pa.binary())])
_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
           ("output", pa.string()), ("boundaries", _INDEX)]
RESULT = ("struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string,"
          "boundaries:struct<rank:array<long>,offset:array<long>,slope:array<double>,residuals:binary>>")


def boundaries(raw: bytes) -> np.ndarray:
    """Offsets, in code points, of the ends of all lines of a UTF-8 text, and 0."""
    if not raw:
        return np.zeros(1, dtype=np.int64)
    buf = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(buf == 10) + 1
    if not len(ends) or ends[-1] != len(buf):
        ends = np.append(ends, len(buf))
    if not raw.isascii():
        starts = np.concatenate(([0], ends[:-1]))
        ends = np.cumsum(np.add.reduceat((buf & 0xC0) != 0x80, starts, dtype=np.int64))
    return np.concatenate(([0], ends)).astype(np.int64)


@dataclass
class RankIndex:
    """Straight segments (first rank, offset there, slope) and a residual for every rank."""

    rank: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residuals: np.ndarray

    @staticmethod
    def _kind(max_error: int) -> type:
        return np.int8 if max_error < 127 else np.int16 if max_error < 2 ** 15 - 1 else np.int64

    @classmethod
    def fit(cls, offsets: np.ndarray, max_error: int = MAX_ERROR) -> RankIndex:
        firsts, slopes, at, n = [], [], 0, len(offsets)
        while at < n:
            low, high, to, step = -np.inf, np.inf, at + 1, 64
            while to < n:
                away = np.arange(to - at, min(to + step, n) - at)
                rise = offsets[to:to + step] - offsets[at]
                lows = np.maximum(np.maximum.accumulate((rise - max_error) / away), low)
                highs = np.minimum(np.minimum.accumulate((rise + max_error) / away), high)
                out = int(np.searchsorted(lows > highs, True))  # once the cone is empty it stays so
                if out:
                    low, high = lows[out - 1], highs[out - 1]
                to += out
                if out < len(away):
                    break
                step *= 2
            firsts.append(at)
            slopes.append((low + high) / 2 if to > at + 1 else 0.0)
            at = to
        rank, slope = np.array(firsts, dtype=np.int64), np.array(slopes)
        index = cls(rank, offsets[rank], slope, np.zeros(0))
        index.residuals = (offsets - index.predict(np.arange(n))).astype(cls._kind(max_error))
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        of = np.searchsorted(self.rank, ranks, side="right") - 1
        return self.offset[of] + np.rint(self.slope[of] * (ranks - self.rank[of])).astype(np.int64)

    def at(self, ranks: list[int]) -> list[int]:
        """The exact offsets of boundaries."""
        where = np.array(ranks, dtype=np.int64)
        return (self.predict(where) + self.residuals[where]).tolist()

    def stored(self) -> dict:
        return {"rank": self.rank, "offset": self.offset, "slope": self.slope, "residuals": self.residuals.tobytes()}

    @classmethod
    def restored(cls, row, max_error: int = MAX_ERROR) -> RankIndex:
        """From a row of the column ``boundaries``."""
        return cls(np.array(row["rank"], dtype=np.int64), np.array(row["offset"], dtype=np.int64), np.array(row["slope"], dtype=float),
                   np.frombuffer(row["residuals"], dtype=cls._kind(max_error)))


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers below 2**32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(raw: bytes, h: list[int], fim_percent: int, spm_percent: int, markers: tuple[str, str, str], max_error: int) -> tuple:
    """The fields of RESULT for one text."""
    index = RankIndex.fit(boundaries(raw), max_error)
    n, text = len(index.residuals) - 1, raw.decode("utf-8", "replace")
    if not text or any(m in text for m in markers) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text, index.stored()
    a, b = index.at(sorted((h[0] % (n + 1), h[1] % (n + 1))))
    before, after, between = markers
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{after}{suffix}{before}{prefix}{between}{middle}", index.stored()
    return n, "psm", a, b - a, f"{before}{prefix}{after}{suffix}{between}{middle}", index.stored()


def restore_text(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """The text that an output was made of; its parts hold no marker, so the first ones are the dividing ones."""
    if form == "plain":
        return output
    before, after, between = markers
    one, two = (before, after) if form == "psm" else (after, before)
    first, _, rest = output[len(one):].partition(two)
    second, _, middle = rest.partition(between)
    return first + middle + second if form == "psm" else second + middle + first


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            yield pa.array((restore_text(o.as_py(), f.as_py(), markers) for o, f in zip(outputs, forms, strict=True)), pa.string())

    return run(output, form)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", result_col: str = "fim", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS,
                   max_error: int = MAX_ERROR) -> DataFrame:
    """``docs`` with a struct column (replacing one of that name): number of lines ``n``, ``form``,
    ``prefix_chars``, ``middle_chars``, ``output`` and the index of the text's ``boundaries``."""
    if len(set(markers)) < 3 or not all(markers) or max_error < 1:
        raise ValueError("three different markers and a positive error are needed")

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, numbers in batches:
            rows = [transform(raw.as_py() or b"", h.as_py(), fim_percent, spm_percent, markers, max_error)
                    for raw, h in zip(texts, numbers, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
            yield pa.StructArray.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)],
                                             names=[name for name, _ in _FIELDS])

    return docs.withColumn(result_col, run(F.col(text_col).cast("binary"), draws(F.col(id_col), seed)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs).select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256(concat('7:', doc_id)) AS h FROM documents),
drawn AS (
  SELECT doc_id, body, units, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM texts),
cut AS (
  SELECT doc_id, body, n, units, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, body, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
              ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
