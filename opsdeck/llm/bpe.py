"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut by a regex at safe boundaries before the library sees them: places that no
match of the split pattern can span and where no match looks to the left, so the pieces'
ids joined are the ids of the whole text. A run of one kind of character has no such place
and stays whole.

Defined results: a null or empty text has no ids and decodes to no bytes; bytes that are not
UTF-8 are read as U+FFFD; special strings are ordinary text; ids that the rank file does not
have are an error. Rows are never dropped, merged or reordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts over this many characters are cut.
PIECE_CHARS = 1 << 15
#: After a character that is no white space and before one that is; after a letter and before
#: none; after a digit and before none.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_encodings: dict = {}


def load(rank_file: str, pattern: str):
    """The encoding of a rank file, loaded once in each worker process."""
    key = rank_file, pattern
    if key not in _encodings:
        import base64

        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at the first safe boundary after each ``most`` characters."""
    at = 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if cut is None or cut.start() >= len(text):
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(raw: bytes | None, encoding, piece_chars: int = PIECE_CHARS) -> list[int]:
    """The ids of one text, piece by piece."""
    ids: list[int] = []
    if raw:
        for piece in pieces(raw.decode("utf-8", "replace"), piece_chars):
            ids += encoding.encode_ordinary(piece)
    return ids


def encode(text: Column, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> Column:
    """The token ids of a text column, as array<int>."""
    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load(rank_file, pattern)
        for batch in batches:
            rows = [pa.array(encode_text(raw.as_py(), encoding, piece_chars), pa.int32()) for raw in batch]
            offsets = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.concat_arrays(rows) if rows else pa.array([], pa.int32()))

    return ids(text.cast("binary"))


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """The raw bytes of a column of token ids."""
    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load(rank_file, pattern)
        for batch in batches:
            yield pa.array([encoding.decode_bytes(x.values.to_pylist()) if x.is_valid else b"" for x in batch], pa.binary())

    return raw(ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, *, text_col: str = "text",
                     ids_col: str = "token_ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``docs`` with a column of token ids (replacing one of that name)."""
    return docs.withColumn(ids_col, encode(F.col(text_col), rank_file, pattern, piece_chars))


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, *, text_col: str = "text", ids_col: str = "token_ids",
                      decoded_col: str = "decoded", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``docs`` with the token ids in place of the text, and the bytes they decode to.

    One worker does both, a few hundred rows at a time.
    """
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*kept, F.col(text_col).cast("binary"))
    fields = T.StructType([*docs.select(kept).schema, T.StructField(ids_col, T.ArrayType(T.IntegerType())),
                           T.StructField(decoded_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = [encode_text(raw.as_py(), encoding, piece_chars) for raw in part.column(len(kept))]
                decoded = pa.array([encoding.decode_bytes(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32())), decoded], names=fields.names)

    return rows.mapInArrow(run, fields)


def round_trip(text: Column, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS) -> Column:
    """Number of ids, hash of the ids and hash of the bytes they decode to.

    Encodes and decodes in one worker, a text at a time, so neither ids nor bytes of a whole
    batch are held or sent.
    """
    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load(rank_file, pattern)
        for batch in batches:
            out = []
            for raw in batch:
                ids = encode_text(raw.as_py(), encoding, piece_chars)
                out.append({"n_tokens": len(ids), "ids_sha256": sha256(",".join(map(str, ids)).encode()).hexdigest(),
                            "decoded_sha256": sha256(encoding.decode_bytes(ids)).hexdigest()})
            yield pa.array(out, DIGEST)

    return digest(text.cast("binary"))


def production_vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = round_trip(F.col("text"), *production_vocabulary())
    return docs.select("doc_id", digest.alias("digest")).select("doc_id", "digest.*")
