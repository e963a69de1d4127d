"""Quality rules: word and symbol counts, repeated lines and windows, and suffix-array
repetition.

The suffix array of a text's words is built by prefix doubling (only suffixes that still share
a prefix are sorted again); the longest common prefixes of neighbours give its LCP intervals.
An interval of value l is a repeated substring of l words that occurs at each of its suffixes,
so the longest interval over a suffix says how far the longest repeated substring starting
there reaches. The union of those spans, from a least length on, is the covered part; a text is
rejected when the covered fraction or the longest repeat exceeds its limit.

Everything concerns one text alone: no shuffle, and the texts of an Arrow batch are worked off
in blocks of bounded size (a longer text is a block of its own, about 100 bytes a word).

Defined results: a null or empty text has no words, all counts 0, and fails the base rules;
bytes that are not UTF-8 count as they are. Rows are never merged, so repeated rows get equal
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.llm.words import Texts

BLOCK_BYTES = 1 << 20
#: Repeats shorter than this many words are no sign of a bad text.
MIN_REPEAT_WORDS = 10
#: Limits of the method: percent of the words that repeats cover, words of the longest repeat.
MAX_COVERED_PERCENT = 30
MAX_LONGEST_WORDS = 200

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
RESULT = "struct<" + ",".join(f"{f}:long" for f in _FIELDS) + ">"


def blocks(raw: list[bytes | None], most: int = BLOCK_BYTES) -> Iterator[list[bytes | None]]:
    """Consecutive runs of texts of about ``most`` bytes."""
    block, size = [], 0
    for text in raw:
        n = len(text or b"")
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append(text)
        size += n
    if block:
        yield block


def suffix_array(first_key: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of several sequences in order, and each doubling's ranks.

    ``first_key`` numbers the elements (equal only inside one sequence), ``left`` is how many
    elements of its sequence begin at each position. ``ranks[k]`` is equal for two suffixes
    exactly when their first 2**k elements are.
    """
    n = len(first_key)
    sa = np.argsort(first_key, kind="stable")
    key = first_key[sa]
    start = np.ones(n, dtype=bool)
    start[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    ranks, h = [rank], 1
    while True:
        # places of the array that still share their rank with a neighbour
        open_ = ~start
        open_[:-1] |= ~start[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            return sa, ranks
        sub = sa[at]
        second = np.where(left[sub] > h, rank[np.minimum(sub + h, n - 1)], -1)
        order = np.lexsort((second, rank[sub]))
        sub, second = sub[order], second[order]
        group = rank[sub]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        sa[at] = sub
        start[at] = new
        rank = rank.copy()
        rank[sub] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        ranks.append(rank)
        h *= 2


def neighbour_lcp(sa: np.ndarray, ranks: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in order with the one before it (0 for the first)."""
    n = len(sa)
    lcp = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(ranks[0][sa[1:]] == ranks[0][sa[:-1]]) + 1
    a, b = sa[at - 1], sa[at]
    both = np.minimum(left[a], left[b])
    length = np.zeros(len(at), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        fits = length + step <= both
        x, y = np.where(fits, a + length, 0), np.where(fits, b + length, 0)
        length += np.where(fits & (ranks[k][x] == ranks[k][y]), step, 0)
    lcp[at] = length
    return lcp


def repeat_lengths(words: Texts) -> np.ndarray:
    """For each word, the words of the longest substring starting there that its text repeats."""
    n = len(words.hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((words.hashes, words.doc))
    new = np.ones(n, dtype=bool)
    new[1:] = (words.hashes[order[1:]] != words.hashes[order[:-1]]) | (words.doc[order[1:]] != words.doc[order[:-1]])
    key = np.empty(n, dtype=np.int64)
    key[order] = np.cumsum(new)
    left = words.left()
    sa, ranks = suffix_array(key, left)
    lcp = neighbour_lcp(sa, ranks, left)
    longest = np.empty(n, dtype=np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return longest


def covered(at: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Whether each of n places lies in one of the spans [at, at + length)."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _dup_lines(text: bytes | None) -> int:
    lines = [x for x in (text or b"").split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(raw: list[bytes | None], min_repeat: int = MIN_REPEAT_WORDS) -> dict[str, np.ndarray]:
    """The measures of a block of texts, an array each."""
    words = Texts(raw)
    buf, n = words.buf, len(words.hashes)
    begin = np.minimum(words.begin, len(buf))
    at, window = words.windows(3)
    order = np.lexsort((window, words.doc[at]))
    same = (window[order[1:]] == window[order[:-1]]) & (words.doc[at[order[1:]]] == words.doc[at[order[:-1]]])
    again = np.zeros(len(at), dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    longest = repeat_lengths(words)
    long = np.flatnonzero(longest >= min_repeat)
    most = np.zeros(len(raw), dtype=np.int64)
    np.maximum.at(most, words.doc, longest)
    starts_char = (buf & 0xC0) != 0x80
    space = np.isin(buf, np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
    return {
        "n_words": words.n_words,
        "word_chars": _per_text(starts_char & ~space, begin),
        "n_symbols": _per_text(_SYMBOL[buf], begin),
        "n_dup_lines": np.array([_dup_lines(t) for t in raw], dtype=np.int64),
        "n_repeat_words": _per_text(covered(at[again], 3, n), words.first),
        "covered_words": _per_text(covered(long, longest[long], n), words.first),
        "longest_repeat": most,
    }


def measures(text: Column, min_repeat: int = MIN_REPEAT_WORDS) -> Column:
    """A struct of the measures of each text."""
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [measure(b, min_repeat) for b in blocks(batch.to_pylist())]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([p[f] for p in parts]) if parts else [], pa.int64()) for f in _FIELDS],
                names=list(_FIELDS))

    return run(text.cast("binary"))


def with_quality(docs: DataFrame, text_col: str = "text", result_col: str = "quality",
                 min_repeat: int = MIN_REPEAT_WORDS, max_covered_percent: float = MAX_COVERED_PERCENT,
                 max_longest: int = MAX_LONGEST_WORDS) -> DataFrame:
    """``docs`` with a struct column (replacing one of that name): the measures,
    ``base_failed`` and ``kept``."""
    q = F.col(result_col)
    base = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    bad = (100 * q["covered_words"] > max_covered_percent * q["n_words"]) | (q["longest_repeat"] > max_longest)
    out = docs.withColumn(result_col, measures(F.col(text_col), min_repeat))
    return out.withColumn(result_col, F.struct(*[q[f].alias(f) for f in _FIELDS], base.alias("base_failed"),
                                               (~base & ~bad).alias("kept")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_quality(docs).select("doc_id", "quality.*")
