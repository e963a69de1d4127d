"""Dropping lines that several documents share, by streaming a range-partitioned sort of line hashes.

1. Every line long enough gives a row: the 128-bit hash of its key (the line stripped and with A-Z
   lower-cased), its document and position. A map task sends the lines of rows that are equal in id
   and text once, as they get equal results.
2. The rows are range-partitioned and sorted by (hash, document descending, position). A range
   border may lie anywhere, also between two rows of one hash, so a line that a third of all
   documents hold is spread like any other rows.
3. A task streams its partition. Within a hash the first document met is the one that keeps its
   lines; from the ``min_docs``-th document on every line is dropped at once, and only the lines of
   the few documents between wait for it. Only the first and the last hash of a partition can go on
   in another one: for them the task hands out the ids of their first ``min_docs`` documents, and
   leaves the lines that those decide to a join of these few rows over all partitions.
4. The dropped lines of a document become a *keep* bitmap (a bit per line, compressed), which is
   what the operator returns: no text moves until somebody applies the bitmaps.

Defined results: a null or empty text is one empty line and loses nothing; rows that share an id
are one document, and the rows without an id are one document too, smaller than any other; a
document that holds a line several times keeps or loses all of them; equal rows get equal results;
ids must be integers. Lines are told apart by 128 bits of hash, rows of one id by 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdeck.llm.common import fresh
from opsdeck.llm.components import written

MIN_CHARS = 20
MIN_DOCS = 3
BATCH_LINES = 100_000
_BLANKS = b" \t\n\x0b\x0c\r"
LINES = "key binary, doc_id long, row long, pos int, n_lines int"
#: kind 0: a dropped line; 1: a line that the join decides; 2: a document of a hash at a partition's edge.
VERDICTS = "kind byte, key binary, doc_id long, row long, pos int, n_lines int"
BITMAPS = "doc_id long, row long, n_lines long, n_dropped long, keep binary"


def line_keys(raw: bytes, min_chars: int = MIN_CHARS) -> tuple[list[int], list[bytes], int]:
    """Positions and key hashes of the lines long enough, and the number of all lines of a text."""
    from xxhash import xxh3_128_digest

    at, keys = [], []
    lines = raw.lower().split(b"\n")  # bytes.lower() changes A-Z only
    for i, line in enumerate(lines):
        key = line.strip(_BLANKS)
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            at.append(i)
            keys.append(xxh3_128_digest(key))
    return at, keys, len(lines)


def _identified(docs: DataFrame, id_col: str, text_col: str, id_as: str, row_as: str) -> DataFrame:
    """``docs`` with the integer id and a hash of id and text."""
    return docs.withColumns({id_as: F.col(id_col).cast("long"), row_as: F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))})


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, doc_id, row, pos, n_lines) of every line long enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, keys, of, n_lines, ids, rows = set(), [], [], [], [], [], []

        def rest() -> pa.RecordBatch:
            which = pa.array(of, pa.int32())
            take = [pa.array(ids, pa.int64()).take(which), pa.array(rows, pa.int64()).take(which)]
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *take, pa.array(at, pa.int32()),
                                              pa.array(n_lines, pa.int32()).take(which)], names=["key", "doc_id", "row", "pos", "n_lines"])
            for x in (at, keys, of, n_lines, ids, rows):
                x.clear()
            return out

        for batch in batches:
            for doc_id, row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not raw.is_valid or (doc_id, row) in seen:
                    continue
                seen.add((doc_id, row))
                where, found, n = line_keys(raw.as_py(), min_chars)
                at += where
                keys += found
                of += [len(ids)] * len(where)
                ids.append(doc_id)
                rows.append(row)
                n_lines.append(n)
                if len(at) >= BATCH_LINES:
                    yield rest()
        if at:
            yield rest()

    docs = _identified(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", "doc_id", "row")
    return docs.select("doc_id", "row", F.col("text").cast("binary")).mapInArrow(run, LINES)


@dataclass
class Stream:
    """What a task remembers between two batches of its sorted rows."""

    min_docs: int
    key: bytes | None = None       # of the run at hand
    doc: int | None = None         # its last document
    n_docs: int = 0                # of the run so far
    first: bool = True             # whether the run began the partition
    waiting: list[pa.RecordBatch] | None = None  # its lines that a later document decides
    docs: list[int | None] | None = None         # its first ``min_docs`` documents


def _rows(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, dtype=np.int8)), *rows.columns], names=["kind", *rows.schema.names])


def _edge(state: Stream, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What a partition knows of the run at hand when it can't tell whether that goes on elsewhere."""
    n = len(state.docs)
    none = [pa.nulls(n, schema.field(c).type) for c in ("row", "pos", "n_lines")]
    yield _rows(2, pa.RecordBatch.from_arrays([pa.array([state.key] * n, pa.binary()), pa.array(state.docs, pa.int64()), *none], names=schema.names))
    for rows in state.waiting:
        yield _rows(1, rows)


def _changes(column: pa.Array, before) -> np.ndarray:
    """Whether each value differs from the one before it (nulls are equal)."""
    if column.null_count:
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    elif pa.types.is_binary(column.type):
        code = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    else:
        code = column.to_numpy(zero_copy_only=False)
    out = np.ones(len(code), dtype=bool)
    out[1:] = code[1:] != code[:-1]
    out[0] = column[0].as_py() != before
    return out


def _feed(batch: pa.RecordBatch, rank: np.ndarray, at: int, state: Stream) -> Iterator[pa.RecordBatch]:
    """More rows of the run at hand, which lie at a place of the batch; ``rank`` numbers their documents."""
    need = state.min_docs
    new = np.flatnonzero(np.diff(rank, prepend=state.n_docs))
    for i in new[: max(0, need - len(state.docs))]:
        state.docs.append(batch.column(1)[int(at + i)].as_py())
    state.n_docs = int(rank[-1])
    # the first document of a run keeps its lines, unless the run may have begun in another partition
    cut = int(np.searchsorted(rank, need))
    begin = 0 if state.first else int(np.searchsorted(rank, 2))
    if begin < cut:
        state.waiting.append(batch.slice(at + begin, cut - begin))
    if not state.first and state.n_docs >= need:
        for rows in state.waiting:
            yield _rows(0, rows)
        state.waiting = []
    if cut < len(rank):
        yield _rows(0, batch.slice(at + cut, len(rank) - cut))


def _judge(batch: pa.RecordBatch, state: Stream) -> Iterator[pa.RecordBatch]:
    """Verdicts of a batch of sorted rows; the last run is kept in mind."""
    keys, n, started = batch.column(0), batch.num_rows, state.key is not None
    new_run = _changes(keys, state.key)
    new_doc = new_run | _changes(batch.column(1), state.doc if started else object())
    docs = np.concatenate(([0], np.cumsum(new_doc)))
    starts = np.flatnonzero(new_run)
    ends = np.append(starts[1:], n)
    if not len(starts) or starts[0]:  # the run at hand goes on
        end = starts[0] if len(starts) else n
        yield from _feed(batch, state.n_docs + docs[1:end + 1], 0, state)
    inside = np.zeros(len(starts), dtype=bool)
    inside[0 if started else 1:-1] = True  # runs that begin and end here, and don't begin the partition
    for k in np.flatnonzero(~inside):
        a, b = int(starts[k]), int(ends[k])
        if state.key is not None:  # the run at hand has ended
            yield from _edge(state, batch.schema) if state.first else ()
            state.first = False
        state.key, state.n_docs, state.waiting, state.docs = keys[a].as_py(), 0, [], []
        yield from _feed(batch, docs[a + 1:b + 1] - docs[a], a, state)
    many = inside & (docs[ends] - docs[starts] >= state.min_docs)
    if many.any():
        of = np.cumsum(new_run) - 1
        rank = docs[1:] - docs[starts[of]]
        yield _rows(0, batch.filter(pa.array(many[of] & (rank > 1) & (of >= 0))))
    state.doc = batch.column(1)[n - 1].as_py()


def verdicts(lines: DataFrame, min_docs: int) -> DataFrame:
    """Dropped lines, lines to be decided, and what the partitions know of the hashes at their edges."""
    order = ["key", F.col("doc_id").desc_nulls_last(), "row", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, schema = Stream(min_docs), None
        for batch in batches:
            if batch.num_rows:
                schema = batch.schema
                yield from _judge(batch, state)
        if schema is not None:
            yield from _edge(state, schema)

    return lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, VERDICTS)


def _bitmaps(dropped: DataFrame) -> DataFrame:
    """Keep bitmaps from (doc_id, row, pos, n_lines) of dropped lines, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone"), strict=True):
                bits = np.ones(n, dtype=bool)
                bits[gone.values.to_numpy()] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pc.cast(batch.column("n_lines"), pa.int64()),
                 pc.cast(pc.list_value_length(batch.column("gone")), pa.int64()), pa.array(keep, pa.binary())],
                names=["doc_id", "row", "n_lines", "n_dropped", "keep"])

    gone = dropped.groupBy("doc_id", "row", "n_lines").agg(F.collect_list("pos").alias("gone"))
    return gone.mapInArrow(run, BITMAPS)


def keep_bitmaps(docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_lines, n_dropped, keep) of the documents that lose a line; ``row`` is a hash of
    id and text, ``keep`` the compressed bits of their lines (first line first, 1: it stays).

    Intermediate tables go to the shared checkpoint folder.
    """
    if min_docs < 2 or min_chars < 1:
        raise ValueError("min_docs must be 2 or more and min_chars positive")
    found = written(verdicts(lines_of(docs, id_col, text_col, min_chars), min_docs), "line-verdicts")
    edges = found.filter("kind = 2").select("key", "doc_id").distinct().groupBy("key").agg(
        F.count("*").alias("n"), F.max("doc_id").alias("largest")).filter(F.col("n") >= min_docs)
    open_lines = found.filter("kind = 1").join(edges, "key").filter(~F.col("doc_id").eqNullSafe(F.col("largest")))
    fields = ["doc_id", "row", "pos", "n_lines"]
    return _bitmaps(found.filter("kind = 0").select(fields).union(open_lines.select(fields)).distinct())


def with_lines_dropped(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by the lines that ``bitmaps`` keep, and ``n_lines`` and
    ``n_dropped`` (columns of those names are replaced)."""
    id_as, row_as, keep_as, kept_as = (fresh(docs, x) for x in ("line_id", "line_row", "line_keep", "line_kept"))

    @F.arrow_udf("struct<text:string,n_lines:long,n_dropped:long>")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keeps in batches:
            out, counts, gone = [], [], []
            for raw, keep in zip(texts, keeps, strict=True):
                text = raw.as_py() or b""
                n = text.count(b"\n") + 1
                if keep.is_valid:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), dtype=np.uint8), count=n)
                    text = b"\n".join(compress(text.split(b"\n"), bits.tolist()))
                    gone.append(n - int(bits.sum()))
                else:
                    gone.append(0)
                out.append(text.decode("utf-8", "replace"))
                counts.append(n)
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                                             names=["text", "n_lines", "n_dropped"])

    rows = _identified(docs, id_col, text_col, id_as, row_as)
    maps = bitmaps.select(F.col("doc_id").alias("map_id__"), F.col("row").alias("map_row__"), F.col("keep").alias(keep_as))
    joined = rows.join(maps, F.col(id_as).eqNullSafe(F.col("map_id__")) & (F.col(row_as) == F.col("map_row__")), "left")
    joined = joined.withColumn(kept_as, kept(F.col(text_col).cast("binary"), F.col(keep_as)))
    done = joined.withColumns({text_col: F.col(kept_as)["text"], "n_lines": F.col(kept_as)["n_lines"], "n_dropped": F.col(kept_as)["n_dropped"]})
    extra = [c for c in ("n_lines", "n_dropped") if c.lower() not in {x.lower() for x in docs.columns}]
    return done.select(*docs.columns, *extra)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines that ``keep_bitmaps`` drops, with ``n_lines`` and ``n_dropped``."""
    names = {k: v for k, v in options.items() if k in ("id_col", "text_col")}
    # a written table, so that both sides of the join are plain rows, which Spark splits where they are skewed
    return with_lines_dropped(docs, written(keep_bitmaps(docs, **options), "line-bitmaps"), **names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i FROM texts),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT y.doc_id, y.i, y.line, s.k IS NOT NULL AND y.doc_id <> s.last AS gone FROM keyed y LEFT JOIN shared s ON s.k = y.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
