"""Removing word sequences that occur again, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``block`` words, which are indexed;
every rolling window of ``block`` words of every text probes the index. A repeat of ``window``
words holds a whole block of its twin, so wherever one occurs a probe hits; with
``block <= (window + 1) // 2`` none is missed. Hits are extended: each window of ``window``
words around a hit is looked up by its content over all documents, and a run of windows that
occur again is a maximal exact repeat. All its words are removed, in every copy.

Texts meet through packed keys (``opsdeck.llm.exchange``): probes by 40 bits and the bucket,
where a collision only adds a window to look up; windows by more than 100 bits, which decide.
A passage that a third of all documents share costs one key per chunk.

Defined results: a null or empty text has no words, nothing is removed and the kept text is
empty; texts shorter than the window keep everything; repeated rows are documents of their
own, so rows with equal texts of a window or more lose all of it; kept words are joined by
one space.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdeck.llm import exchange
from opsdeck.llm.common import fresh
from opsdeck.llm.words import Texts

WINDOW = 35
PROBE_BYTES = 5


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of pairs of keys, starts of equal runs in it, and the run of each pair."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    run = np.empty(len(a), dtype=np.int64)
    run[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), run


def _probes(words: Texts, block: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places that probe, the distinct probe keys, each place's key, and whether it is a block."""
    at = np.flatnonzero((words.left() >= block) & (words.n_words[words.doc] >= window))
    keys, which = np.unique(words.window_hashes(at, block), return_inverse=True)
    return at, keys, which, (at - words.first[words.doc[at]]) % block == 0


def _to_check(words: Texts, hit: np.ndarray, block: int, window: int) -> np.ndarray:
    """Starts of the windows that hold a block's length beginning at a hit."""
    total = np.concatenate(([0], np.cumsum(hit)))
    at = np.flatnonzero(words.left() >= window)
    return at[total[at + window - block + 1] > total[at]]


def repeated_words(docs: DataFrame, *, window: int = WINDOW, block: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text", sizes: exchange.Layout | None = None) -> DataFrame:
    """All columns of ``docs`` (the text replaced by its kept words), with ``n_words``,
    ``n_removed`` and ``spans``, the maximal runs of removed words as [begin, end).

    Columns of those three names are replaced.
    """
    block = (window + 1) // 2 if block is None else block
    if not 0 < block <= (window + 1) // 2:
        raise ValueError("a block must not be longer than half the window, rounded up")
    added = ("n_words", "n_removed", "spans")
    docs = docs.drop(*added)
    sizes = sizes or exchange.layout(docs, text_col)
    chunk = fresh(docs, exchange.CHUNK)
    chunks = exchange.chunked(docs.withColumn(text_col, F.col(text_col).cast("binary")), [F.col(id_col), F.col(text_col)],
                              sizes.n_chunks, chunk)
    order, n_buckets = [id_col, text_col], sizes.n_buckets

    def probe(rows: pa.Table, _, to: exchange.Requests) -> None:
        words = Texts(rows[text_col].to_pylist())
        _, keys, which, is_block = _probes(words, block, window)
        many = np.bincount(which, minlength=len(keys)) > 1
        blocks = np.bincount(which, is_block, minlength=len(keys)) > 0
        to.send(keys, PROBE_BYTES, lambda p: exchange.pack_bits(np.concatenate((many[p], blocks[p]))))

    def match(keys: list[bytes], extras: list[bytes]) -> list[bytes]:
        """A key is a hit if it occurs more than once, and as a block."""
        parts = [exchange.unpack(k, PROBE_BYTES) for k in keys]
        flags = [exchange.unpack_bits(e, 2 * len(p)) for e, p in zip(extras, parts, strict=True)]
        distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
        many = np.concatenate([f[: len(p)] for f, p in zip(flags, parts, strict=True)])
        blocks = np.concatenate([f[len(p):] for f, p in zip(flags, parts, strict=True)])
        n = np.bincount(which, 1 + many, minlength=len(distinct))
        hit = ((n > 1) & (np.bincount(which, blocks, minlength=len(distinct)) > 0))[which]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return [exchange.pack_bits(h) for h in np.split(hit, cuts)]

    def window_keys(words: Texts, at: np.ndarray):
        first, second = words.window_hashes(at, window), words.window_hashes(at, window, 1)
        return first, second, *_distinct(first, second)

    def extend(rows: pa.Table, back: exchange.Answers, to: exchange.Requests) -> None:
        words = Texts(rows[text_col].to_pylist())
        at, keys, which, _ = _probes(words, block, window)
        hit = np.zeros(len(words.hashes), dtype=bool)
        hit[at] = back.bits(keys, n_buckets)[which]
        first, second, by, starts, run = window_keys(words, _to_check(words, hit, block, window))
        some = by[starts]
        many = np.bincount(run, minlength=len(starts)) > 1
        to.send(first[some], 8, lambda p: exchange.pack_bits(many[p]) + second[some][p].tobytes())
        to.remember(zlib.compress(exchange.pack_bits(hit), 1))

    def again(keys: list[bytes], extras: list[bytes]) -> list[bytes]:
        """A window is repeated if it has a second place anywhere."""
        first = [exchange.unpack(k, 8) for k in keys]
        cuts = [-(-len(f) // 8) for f in first]
        many = np.concatenate([exchange.unpack_bits(e[:c], len(f)) for e, c, f in zip(extras, cuts, first, strict=True)])
        second = np.concatenate([np.frombuffer(e[c:], dtype=np.uint64) for e, c in zip(extras, cuts, strict=True)])
        _, starts, run = _distinct(np.concatenate(first), second)
        n = np.bincount(run, 1 + many, minlength=len(starts))
        return [exchange.pack_bits(h) for h in np.split((n > 1)[run], np.cumsum([len(f) for f in first])[:-1])]

    out_fields = [f for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString() if f.name != text_col else 'string'}" for f in out_fields)
    schema += ", n_words long, n_removed long, spans array<struct<begin:long,end:long>>"

    def remove(rows: pa.Table, back: exchange.Answers) -> pa.Table:
        raw = rows[text_col].to_pylist()
        words = Texts(raw)
        hit = exchange.unpack_bits(zlib.decompress(back.notes[0]), len(words.hashes))
        at = _to_check(words, hit, block, window)
        first, _, by, starts, run = window_keys(words, at)
        at = at[back.bits(first[by[starts]], n_buckets)[run]]
        change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept, removed, spans = [], [], []
        for i, text in enumerate(raw):
            mine = gone[words.first[i]:words.first[i + 1]]
            n = int(mine.sum())
            parts = (text or b"").split()
            kept.append(b" ".join(compress(parts, (~mine).tolist()) if n else parts).decode("utf-8", "replace"))
            removed.append(n)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0])))) if n else []
            spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        columns = [pa.array(kept, pa.string()) if f.name == text_col else rows[f.name] for f in out_fields]
        columns += [pa.array(words.n_words, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in columns],
                                    names=[f.name for f in out_fields] + list(added))

    hits = exchange.answer(exchange.requests(chunks, order, n_buckets, probe, chunk_col=chunk), match)
    repeats = exchange.answer(exchange.requests(chunks, order, n_buckets, extend, hits, chunk), again)
    return exchange.finish(chunks, repeats, order, remove, schema, chunk)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
windows AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER ahead AS body, count(*) OVER ahead AS n FROM places
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
again AS (SELECT body FROM windows WHERE n = 35 GROUP BY body HAVING count(*) > 1),
marked AS (
  SELECT w.doc_id, w.i, w.word, CASE WHEN w.n = 35 AND a.body IS NOT NULL THEN 1 ELSE 0 END AS starts
  FROM windows w LEFT JOIN again a ON w.n = 35 AND w.body = a.body),
judged AS (
  SELECT doc_id, i, word, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM marked),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS body
  FROM judged GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
