"""Asking all documents about keys, in bulk.

Several operators must know, for every n-gram of every document, something about that n-gram
in all documents (how many hold it, whether it occurs again). Row by row that is a shuffle of
one row per word and back. Here documents lie in *chunks* (a hash of id and text, a few MB of
text each). A chunk reduces its n-grams to distinct 64-bit keys, sorts them, and sends each
range of keys, as one packed row, to the *bucket* of that range. A bucket merges what all
chunks sent, and answers every row with one packed row; the answers of a chunk, put in bucket
order, line up with its sorted keys again, so neither documents nor positions travel.

* A hot key is sent once per chunk, however often it occurs: no bucket gets a hot group.
* Chunks and buckets hold a fixed number of bytes, so their number grows with the input and
  the memory of a task doesn't.
* A chunk's rows are put in order of id and text before they are read, so a chunk that is
  computed again (a lost executor, a later step) has the same keys in the same order.
* The steps of an operator read the same shuffle of the texts; Spark reuses it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.llm.common import text_bytes

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20  # of text whose keys a bucket holds
CHUNK = "chunk__"
REQUEST = "bucket int, chunk int, note boolean, keys binary, extra binary"
ANSWER = "chunk int, bucket int, note boolean, payload binary"


@dataclass(frozen=True)
class Layout:
    n_chunks: int
    n_buckets: int


def layout(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Layout:
    """Numbers of chunks and buckets for the bytes of a text column (one scan of it)."""
    n = text_bytes(docs, text_col)
    return Layout(max(1, math.ceil(n / chunk_bytes)), max(1, math.ceil(n / bucket_bytes)))


def chunked(docs: DataFrame, key: list[Column], n_chunks: int, chunk_col: str = CHUNK) -> DataFrame:
    """``docs`` with the number of each row's chunk, in a column whose name it doesn't have yet."""
    return docs.withColumn(chunk_col, F.pmod(F.xxhash64(*key), F.lit(n_chunks)).cast("int"))


def packed(chunks: DataFrame, chunk_col: str = CHUNK) -> DataFrame:
    """(chunk, rows): the rows that a task has of a chunk, compressed together, so that a shuffle
    of long texts moves and stores a fraction of their bytes. ``requests`` and ``finish`` read
    them with ``compressed``."""
    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            number = batch.column(chunk_col).to_numpy()
            order = np.argsort(number, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                if len(part):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                        writer.write_batch(batch.take(pa.array(part)))
                    yield pa.RecordBatch.from_arrays([pa.array([number[part[0]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                     names=[chunk_col, "rows"])

    return chunks.mapInArrow(run, f"`{chunk_col}` int, rows binary")


def _unpacked(rows: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(blob.as_buffer()).read_all() for part in rows["rows"].chunks for blob in part])


def pack(keys: np.ndarray, n_bytes: int) -> bytes:
    """The low bytes of 64-bit keys."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes]).tobytes()


def unpack(blob: bytes, n_bytes: int) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(-1, n_bytes)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :n_bytes] = raw
    return out.view("<u8").ravel()


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)


def ranges(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where the key range of each bucket begins in sorted keys (and the end)."""
    border = np.array([-(-(b << 64) // n_buckets) for b in range(1, n_buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, border), [len(keys)])).astype(np.int64)


@dataclass
class Requests:
    """The rows that a chunk sends."""

    chunk: int
    n_buckets: int
    rows: list[dict] = field(default_factory=list)

    def send(self, keys: np.ndarray, n_bytes: int | Callable[[np.ndarray], bytes], extra: Callable[[slice], bytes] | None = None,
             first: int = 0) -> None:
        """Sorted keys, by bucket, with what ``extra`` gives for each range of them; ``n_bytes`` of a key, or what packs them.
        ``first`` is added to the buckets' numbers."""
        at = ranges(keys, self.n_buckets)
        for b in np.flatnonzero(at[1:] > at[:-1]):
            part = slice(at[b], at[b + 1])
            self.rows.append({"bucket": int(b) + first, "chunk": self.chunk, "note": False, "keys": n_bytes(keys[part]) if callable(n_bytes) else pack(keys[part], n_bytes),
                              "extra": extra(part) if extra else None})

    def remember(self, blob: bytes) -> None:
        """A note that comes back to this chunk with the answers."""
        self.rows.append({"bucket": self.chunk % self.n_buckets, "chunk": self.chunk, "note": True, "keys": b"", "extra": blob})


@dataclass
class Answers:
    """What a chunk got back."""

    payloads: list[bytes]  # in bucket order
    notes: list[bytes]  # likewise; from the chunk itself, or totals for all chunks

    def bits(self, keys: np.ndarray, n_buckets: int) -> np.ndarray:
        """One flag for each of the sorted keys that were sent."""
        at = ranges(keys, n_buckets)
        sizes = [n for n in np.diff(at) if n]
        return np.concatenate([unpack_bits(p, n) for p, n in zip(self.payloads, sizes, strict=True)]) if sizes else np.zeros(0, bool)

    def numbers(self, kind: str) -> np.ndarray:
        """One number for each of the sorted keys that were sent."""
        return np.concatenate([np.frombuffer(p, dtype=kind) for p in self.payloads]) if self.payloads else np.zeros(0, kind)


def _ordered(rows: pa.Table, by: list[str]) -> pa.Table:
    return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in by])) if rows.num_rows > 1 else rows


def _answers(rows: pa.Table) -> Answers:
    rows = rows.sort_by("bucket")
    notes = rows.filter(rows["note"])
    return Answers(rows.filter(pc.invert(rows["note"]))["payload"].to_pylist(), notes["payload"].to_pylist())


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_REQUEST = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("note", pa.bool_()), ("keys", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("note", pa.bool_()), ("payload", pa.binary())])


def requests(chunks: DataFrame, order: list[str], n_buckets: int, make: Callable, answers: DataFrame | None = None,
             chunk_col: str = CHUNK, compressed: bool = False) -> DataFrame:
    """``make(rows, answers, Requests)`` for every chunk; the rows are in order."""
    def first(rows: pa.Table) -> pa.Table:
        to = Requests(rows[chunk_col][0].as_py(), n_buckets)
        make(_ordered(_unpacked(rows) if compressed else rows, order), None, to)
        return _table(to.rows, _REQUEST)

    def later(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], _REQUEST)
        to = Requests(rows[chunk_col][0].as_py(), n_buckets)
        make(_ordered(_unpacked(rows) if compressed else rows, order), _answers(back), to)
        return _table(to.rows, _REQUEST)

    by = chunks.groupBy(chunk_col)
    if answers is None:
        return by.applyInArrow(first, REQUEST)
    return by.cogroup(answers.groupBy("chunk")).applyInArrow(later, REQUEST)


def answer(asked: DataFrame, merge: Callable, first: int = 0) -> DataFrame:
    """``merge(keys, extras)`` for every bucket: lists over the chunks in, payloads out.

    ``first`` is added to the buckets' numbers, so that answers of several rounds can be united
    and come in the order of the rounds.
    """
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("chunk", "ascending")])
        notes, keys = rows.filter(rows["note"]), rows.filter(pc.invert(rows["note"]))
        out = [{"chunk": c, "bucket": b, "note": True, "payload": p}
               for c, b, p in zip(*(notes[n].to_pylist() for n in ("chunk", "bucket", "extra")), strict=True)]
        if keys.num_rows:
            payloads = merge(keys["keys"].to_pylist(), keys["extra"].to_pylist())
            out += [{"chunk": c, "bucket": b + first, "note": False, "payload": p}
                    for c, b, p in zip(keys["chunk"].to_pylist(), keys["bucket"].to_pylist(), payloads, strict=True)]
        return _table(out, _ANSWER)

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def summed(asked: DataFrame, count: Callable, n_chunks: int, place: int = -1) -> DataFrame:
    """Totals over all buckets, as a note (JSON of name -> total) for every chunk; notes come in
    the order of ``place``.

    ``count(keys, extras)`` gives a bucket's part as a dict; the rows added up are as few as
    buckets times names.
    """
    def run(rows: pa.Table) -> pa.Table:
        keys = rows.filter(pc.invert(rows["note"]))
        found = count(keys["keys"].to_pylist(), keys["extra"].to_pylist()) if keys.num_rows else {}
        return pa.table({"name": pa.array([str(k) for k in found], pa.string()), "n": pa.array([int(v) for v in found.values()], pa.int64())})

    parts = asked.groupBy("bucket").applyInArrow(run, "name string, n long")
    totals = parts.groupBy("name").agg(F.sum("n").alias("n"))
    whole = totals.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "n")))).alias("json"))
    return whole.select(F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), F.lit(place).alias("bucket"),
                        F.lit(True).alias("note"), F.col("json").cast("binary").alias("payload"))


def finish(chunks: DataFrame, answers: DataFrame, order: list[str], make: Callable, schema: str,
           chunk_col: str = CHUNK, compressed: bool = False) -> DataFrame:
    """``make(rows, answers)`` for every chunk gives a table of ``schema``."""
    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _empty
        return make(_ordered(_unpacked(rows) if compressed else rows, order), _answers(back))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    _empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return chunks.groupBy(chunk_col).cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
