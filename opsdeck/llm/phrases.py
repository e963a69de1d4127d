"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count exactly.

1. The texts are written once as a table of *chunks* (a few MB of text each, as a task meets them).
2. A bounded sample of the documents is counted; what is frequent there, at a lowered threshold, is
   proposed. The *negative border* are the phrases that were not proposed though their two longest
   parts (without the last, without the first word) were; every word belongs to it or to the proposals.
3. A full pass counts proposals and border exactly: a chunk sends its distinct phrases of both kinds
   with their numbers, sorted by key and packed into a row per *bucket* (a range of keys, as many as
   there are 4 MB of text). A bucket adds them up, and what is frequent goes back, packed again, to
   the chunks that hold it: a phrase with a number is 13 bytes of a row, not a row.
4. If a border phrase (or a word the sample didn't know) turns out frequent, longer phrases may be
   too: an expansion pass counts the phrases whose two longest parts are now known to be frequent
   and that no pass has counted. This goes on until a pass finds nothing new. Every part of a
   frequent phrase is frequent, so then all are known, whatever the sample was.
5. A chunk that holds a frequent phrase also holds its parts, and so knows their numbers too: one of
   the phrase's chunks scores all its cuts and names the shorter phrases that it absorbs.
6. The first of each language come from a range-partitioned sort (``operators.positions``).

Defined results: a null text has no words; a null language is ``und`` (as is the language of that
name); rows that repeat count as often as they occur; a document of any length is counted whole.
Words are told apart by 64 bits of hash within their language, phrases by 96.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdeck.llm.common import text_bytes
from opsdeck.llm.components import spread_join, written
from opsdeck.llm.exchange import pack_bits, ranges, unpack_bits
from opsdeck.llm.words import mix, split_words, window_hashes
from opsdeck.operators.positions import with_positions

MIN_COUNT = 30
MAX_WORDS = 4
SCALE = 2_000_000
ABSORB_PERCENT = 80
FIRST = 2000
CHUNK_BYTES = 8 << 20
SAMPLE_BYTES = 16 << 20  # of text; so at most 8 M words and 16 M proposals of 8 bytes (each is seen twice)
UNKNOWN = "und"
BUCKET_BYTES = 4 << 20  # of text whose phrases a bucket adds up
COUNTS = "bucket int, chunk long, keys binary, tags binary, n binary, proposed binary"
KNOWN = "chunk long, pass byte, missed long, keys binary, totals binary, own binary, proposed binary"
_NEVER = np.int8(99)

_PLAIN = np.arange(256, dtype=np.uint8)  # A-Z in lower case, ends of pieces as line feeds
_PLAIN[65:91] += 32
_PLAIN[np.frombuffer(b".,;:!?\x0b\x0c\r", dtype=np.uint8)] = 10


class Pieces:
    """The words of several texts: ``hashes`` (of word and language), ``starts``, ``ends`` in ``buf``, ``lang``
    (a number of ``langs``), and the ``piece`` that each word lies in."""

    def __init__(self, texts: list[bytes | None], langs: list[str | None]):
        from xxhash import xxh3_64_intdigest

        raw = [t or b"" for t in texts]
        self.buf = _PLAIN[np.frombuffer(b"\n".join(raw), dtype=np.uint8)]
        self.starts, self.ends, hashes = split_words(self.buf)
        ends_piece = np.flatnonzero(self.buf == 10)
        small = np.int32 if len(self.buf) < 2 ** 31 else np.int64
        self.piece = np.searchsorted(ends_piece, self.starts).astype(small)  # a text ends with a line feed, so pieces lie in one text
        begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        names = [UNKNOWN if x is None else x for x in langs]
        self.langs = sorted(set(names))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.repeat(np.array([number[x] for x in names], dtype=np.int32), np.diff(np.searchsorted(self.starts, begin)))
        self.starts, self.ends = self.starts.astype(small), self.ends.astype(small)
        salt = np.array([xxh3_64_intdigest(x.encode()) for x in self.langs], dtype=np.uint64)
        self.hashes = mix(hashes ^ salt[self.lang]) if len(hashes) else hashes

    def together(self, k: int) -> np.ndarray:
        """For each word, whether k words from it on lie in one piece."""
        out = np.zeros(len(self.piece), dtype=bool)
        if len(out) >= k:
            out[: len(out) - k + 1] = self.piece[k - 1:] == self.piece[: len(out) - k + 1]
        return out

    def names(self, at: np.ndarray, k: int) -> np.ndarray:
        """Key of the phrases of k words at some words."""
        if not len(at):
            return np.zeros(0, dtype=np.uint64)
        return mix(window_hashes(self.hashes, at, k) ^ np.uint64(0x2545F4914F6CDD1D * k & 0xFFFFFFFFFFFFFFFF))

    def tags(self, at: np.ndarray, k: int) -> np.ndarray:
        """Tag of the phrases of k words at some words: 31 more bits that tell them apart."""
        if not len(at):
            return np.zeros(0, dtype=np.int32)
        return (window_hashes(self.hashes, at, k, 1) & np.uint64(0x7FFFFFFF)).astype(np.int32)


@dataclass
class Counted:
    """Distinct phrases of some places: their keys (sorted), tags, numbers and first places; and the places, in the
    order of their phrases."""

    keys: np.ndarray
    tags: np.ndarray
    n: np.ndarray
    first: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, words: Pieces, at: np.ndarray, k: int) -> Counted:
        keys = words.names(at, k)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], at[order]
        del order
        new = np.ones(len(keys), dtype=bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        begin = np.flatnonzero(new)
        first = places[begin]
        return cls(keys[begin], words.tags(first, k), np.diff(begin, append=len(keys)), first, places)


def _found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among sorted ones, and its place there."""
    if not len(among):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    order, place = np.argsort(keys), np.empty(len(keys), dtype=np.int64)
    place[order] = np.searchsorted(among, keys[order])  # several times as fast as keys in any order
    del order
    np.minimum(place, len(among) - 1, out=place)
    return among[place] == keys, place


def _parts_ok(ok: np.ndarray, together: np.ndarray) -> np.ndarray:
    """The places whose two longest parts satisfy ``ok``."""
    both = np.zeros(len(ok), dtype=bool)
    both[:-1] = ok[:-1] & ok[1:]
    return np.flatnonzero(both & together)


def _first_counted(words: Pieces, proposed: np.ndarray, max_words: int) -> Iterator[tuple[int, np.ndarray, Counted, np.ndarray]]:
    """Per length, the places and phrases that the first pass counts (proposals and border), and which were proposed."""
    ok = None
    for k in range(1, max_words + 1):
        at = np.arange(len(words.hashes)) if k == 1 else _parts_ok(ok, words.together(k))
        found = Counted.of(words, at, k)
        hit = _found(found.keys, proposed)[0]
        yield k, at, found, hit
        ok = np.zeros(len(words.hashes), dtype=bool)
        ok[found.places] = np.repeat(hit, found.n)


def _known(words: Pieces, keys: np.ndarray, passes: np.ndarray, totals: np.ndarray, max_words: int):
    """Per length: the pass in which the phrase at each place became known as frequent, and its number."""
    level, total, kind = [None], [None], np.min_scalar_type(int(totals.max(initial=0)))
    for k in range(1, max_words + 1):
        at = np.arange(len(words.hashes)) if k == 1 else _parts_ok(level[k - 1] < _NEVER, words.together(k))
        hit, place = _found(words.names(at, k), keys)
        level.append(np.full(len(words.hashes), _NEVER, dtype=np.int8))
        total.append(np.zeros(len(words.hashes), dtype=kind))
        at, place = at[hit], place[hit]
        level[k][at] = passes[place]
        total[k][at] = totals[place]
    return level, total


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of 0 and more in as few bytes as the largest needs (1, 2, 4 or 8 each)."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"u{len(blob) // n}" if n else "u8").astype(np.int64)


def _keys(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint64)


def _blobs(rows: pa.Table, name: str) -> list[pa.Buffer]:
    """The values of a binary column, not copied."""
    return [x.as_buffer() for part in rows[name].chunks for x in part]


def _sent(chunk: int, counted: list[tuple[np.ndarray, ...]], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's phrases of several lengths (keys, tags, numbers, whether proposed), a row per bucket, sorted by key."""
    keys, tags, n, proposed = (np.concatenate(x) for x in zip(*counted, strict=True))
    counted.clear()
    order = np.argsort(keys)
    keys, tags, n, proposed = (x[order] for x in (keys, tags, n, proposed))
    at = ranges(keys, n_buckets)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        parts = [slice(at[b], at[b + 1]) for b in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk, dtype=np.int64)), pa.array([keys[p].tobytes() for p in parts], pa.binary()),
             pa.array([tags[p].tobytes() for p in parts], pa.binary()), pa.array([_pack(n[p]) for p in parts], pa.binary()),
             pa.array([pack_bits(proposed[p]) for p in parts], pa.binary())], names=["bucket", "chunk", "keys", "tags", "n", "proposed"])


def _chunks(docs: DataFrame, lang_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, rows): the texts and languages of documents that follow one another in a task, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        options = pa.ipc.IpcWriteOptions(compression="zstd")
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                              names=["chunk", "rows"])

        for batch in batches:
            at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(int(np.searchsorted(ends, before + chunk_bytes - size)), at + 1)
                held.append(batch.slice(at, to - at))
                size += int(ends[min(to, len(ends)) - 1]) - before
                at = to
                if size >= chunk_bytes:
                    yield packed()
                    number, held, size = number + 1, [], 0
        if held:
            yield packed()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk long, rows binary")


def _words_of(blob: bytes) -> Pieces:
    rows = pa.ipc.open_stream(blob).read_all()
    return Pieces(rows["text"].to_pylist(), rows["lang"].to_pylist())


def _proposals(docs: DataFrame, total: int, lang_col: str, text_col: str, min_count: int, max_words: int, sample_bytes: int) -> np.ndarray:
    """Sorted keys of the phrases that are frequent in a sample, at half the share of the threshold (twice at least)."""
    rate = min(1.0, sample_bytes / max(1, total))
    sample = docs if rate == 1 else docs.sample(rate, seed=7)
    least = min_count if rate == 1 else max(2, int(rate * min_count / 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Pieces(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            for k in range(1, max_words + 1):
                found = Counted.of(words, np.flatnonzero(words.together(k)), k)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys.view(np.int64)), pa.array(found.n.astype(np.int64))], names=["key", "n"])

    rows = sample.select(F.col(lang_col).cast("string"), F.col(text_col).cast("binary")).mapInArrow(run, "key long, n long")
    frequent = rows.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")
    return np.sort(frequent.toArrow()["key"].to_numpy().view(np.uint64))


_KNOWN = pa.schema([("chunk", pa.int64()), ("pass", pa.int8()), ("missed", pa.int64()), ("keys", pa.binary()), ("totals", pa.binary()),
                    ("own", pa.binary()), ("proposed", pa.binary())])


def _frequent(counts: DataFrame, min_count: int, number: int) -> DataFrame:
    """The frequent phrases of a pass, a row per chunk and bucket: keys, totals, whether the chunk is the first that
    holds the phrase (it owns it), whether it was proposed; ``missed`` are those that were not."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        keys = [_keys(b) for b in _blobs(rows, "keys")]
        sizes = [len(k) for k in keys]
        n = np.concatenate([_unpack(b, size) for b, size in zip(_blobs(rows, "n"), sizes, strict=True)])
        proposed = np.concatenate([unpack_bits(b, size) for b, size in zip(_blobs(rows, "proposed"), sizes, strict=True)])
        keys = np.concatenate(keys)
        tags = np.concatenate([np.frombuffer(b, dtype=np.int32) for b in _blobs(rows, "tags")])
        order = np.lexsort((tags, keys))  # stable: a phrase's first place is the first chunk's
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.diff(keys[order]) != 0
        new[1:] |= np.diff(tags[order]) != 0
        totals, own = np.empty_like(n), np.zeros(len(n), dtype=bool)
        totals[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        own[order[new]] = True
        out, cuts = [], np.cumsum([0, *sizes])
        for chunk, begin, end in zip(rows["chunk"].to_pylist(), cuts, cuts[1:], strict=False):
            p = begin + np.flatnonzero(totals[begin:end] >= min_count)
            if len(p):
                out.append({"chunk": chunk, "pass": number, "missed": int((~proposed[p]).sum()), "keys": keys[p].tobytes(),
                            "totals": _pack(totals[p]), "own": pack_bits(own[p]), "proposed": pack_bits(proposed[p])})
        return pa.Table.from_pylist(out, schema=_KNOWN)

    return counts.groupBy("bucket").applyInArrow(run, KNOWN)


@dataclass
class Have:
    """The frequent phrases that a chunk holds, sorted by key."""

    keys: np.ndarray
    passes: np.ndarray
    totals: np.ndarray
    own: np.ndarray
    proposed: np.ndarray

    @classmethod
    def of(cls, known: pa.Table) -> Have:
        none = np.zeros(0, dtype=np.int64)
        keys = [_keys(b) for b in _blobs(known, "keys")]
        sizes = [len(k) for k in keys]
        totals, own, proposed = ([f(b, n) for b, n in zip(_blobs(known, c), sizes, strict=True)] for c, f in (
            ("totals", _unpack), ("own", unpack_bits), ("proposed", unpack_bits)))
        keys = np.concatenate([none.view(np.uint64), *keys])
        passes = np.repeat(known["pass"].to_numpy(), sizes) if sizes else none.astype(np.int8)
        order = np.argsort(keys)
        flags = (np.concatenate([none.astype(bool), *x])[order] for x in (own, proposed))
        return cls(keys[order], passes[order], np.concatenate([none, *totals])[order], *flags)


def _unpacked(known: DataFrame) -> DataFrame:
    """(chunk, key, total, own, proposed, pass): a row per phrase and chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = _keys(r["keys"])
                m = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, r["chunk"], dtype=np.int64)), pa.array(keys.view(np.int64)), pa.array(_unpack(r["totals"], m)),
                     pa.array(unpack_bits(r["own"], m)), pa.array(unpack_bits(r["proposed"], m)), pa.array(np.full(m, r["pass"], dtype=np.int8))],
                    names=["chunk", "key", "total", "own", "proposed", "pass"])

    return known.mapInArrow(run, "chunk long, key long, total long, own boolean, proposed boolean, pass byte")


_COUNTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("keys", "tags", "n", "proposed"))])


def _expansion(number: int, max_words: int, n_buckets: int):
    """The expansion pass of a number: what it counts in a chunk, given the frequent phrases known so far.

    Only places beside a phrase that the pass before found without a proposal are looked at: what has none
    among its two longest parts was counted before. (The proposals hold every part of a proposal, so the first
    pass counted what has two proposed parts; an expansion counted what had two known ones.)
    """
    def expand(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _COUNTS.empty_table()
        have = Have.of(known)
        latest = have.keys[(have.passes == number - 1) & ~have.proposed]
        if not len(latest):
            return _COUNTS.empty_table()
        chunk, words = rows["chunk"][0].as_py(), _words_of(rows["rows"][0].as_buffer())
        out = []
        for k in range(2, max_words + 1):
            near, part = np.zeros(len(words.hashes) + 1, dtype=bool), np.flatnonzero(words.together(k - 1))
            part = part[_found(words.names(part, k - 1), latest)[0]]
            near[part] = near[part - 1] = True  # a first word has no place before it: the last one stands for that
            at = np.flatnonzero(near[:-1] & words.together(k))
            for i in (0, 1):
                at = at[_found(words.names(at + i, k - 1), have.keys)[0]]
            found = Counted.of(words, at, k)
            out.append((found.keys, found.tags, found.n, np.zeros(len(found.keys), dtype=bool)))
        return pa.Table.from_batches(_sent(chunk, out, n_buckets), schema=_COUNTS)

    return expand


def mine(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
         chunk_bytes: int = CHUNK_BYTES, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """Chunks, all frequent phrases of up to ``max_words`` words (a row per chunk that holds one), and the number of
    expansion passes it took.

    Tables of both go to the shared checkpoint folder. The driver sees the proposals (a bounded sample's) and two
    numbers a pass.
    """
    chunks, known, number = _mined(docs, lang_col, text_col, min_count, max_words, chunk_bytes, sample_bytes)
    return chunks, _unpacked(known), number


def _mined(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
           chunk_bytes: int = CHUNK_BYTES, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """``mine`` with the phrases still packed."""
    if min_count < 2 or max_words < 2:
        raise ValueError("min_count and max_words must be 2 or more")
    chunks = written(_chunks(docs, lang_col, text_col, chunk_bytes), "phrase-chunks")
    size = text_bytes(docs, text_col)
    sample = _proposals(docs, size, lang_col, text_col, min_count, max_words, sample_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    n_buckets = max(1, -(-size // BUCKET_BYTES))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counted = [(found.keys, found.tags, found.n, hit) for _, _, found, hit in
                           _first_counted(_words_of(blob.as_buffer()), shared.value, max_words)]
                yield from _sent(chunk, counted, n_buckets)

    known = written(_frequent(chunks.mapInArrow(first_pass, COUNTS), min_count, 0), "phrases")
    failures, number = known.filter("missed > 0").limit(1).count(), 0
    while failures:
        number += 1
        counts = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_expansion(number, max_words, n_buckets), COUNTS)
        more = written(_frequent(counts, min_count, number), "phrases")
        failures = more.limit(1).count()
        known = known.union(more)
    return chunks, known, number


PHRASE = "lang string, phrase string, key long, a long, l long, r long, score long, absorbs array<long>, n long"


def _score(a: np.ndarray, both: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * a / both), exact also where the product passes 64 bits."""
    if len(a) and int(a.max()) > (2 ** 63 - 1) // scale:
        return np.array([scale * int(x) // int(y) for x, y in zip(a, both, strict=True)], dtype=np.int64)
    return scale * a // both


def _scored(words: Pieces, have: Have, max_words: int, absorb_percent: int, scale: int) -> list[dict]:
    """The phrases that a chunk owns: number, the cut with the lowest score, the shorter phrases they absorb; and the
    number of words of each language (a row without a phrase)."""
    keys, passes, totals, own = have.keys, have.passes, have.totals, have.own
    level, total = _known(words, keys, passes, totals, max_words)

    def number(k: int, at: np.ndarray) -> np.ndarray:
        return total[k][at].astype(np.int64)

    out = [{"lang": words.langs[i], "n": int(n)} for i, n in enumerate(np.bincount(words.lang, minlength=len(words.langs))) if n]
    for k in range(2, max_words + 1):
        found = Counted.of(words, np.flatnonzero(level[k] < _NEVER), k)
        mine = own[_found(found.keys, keys)[1]] if len(found.keys) else np.zeros(0, dtype=bool)
        at, key = found.first[mine], found.keys[mine]
        if not len(at):
            continue
        a = number(k, at)
        parts = [(number(c, at), number(k - c, at + c)) for c in range(1, k)]
        scores = np.array([_score(a, left + right, scale) for left, right in parts])
        cut = np.argmin(scores, axis=0)  # the first of the lowest
        some = np.arange(len(at))
        lefts, rights = (np.array([p[i] for p in parts])[cut, some] for i in (0, 1))
        inner = [(words.names(at + o, m).view(np.int64), number(m, at + o)) for m in range(2, k) for o in range(k - m + 1)]
        for i in range(len(at)):
            p, times = int(at[i]), int(a[i])
            text = b" ".join(words.buf[words.starts[j]:words.ends[j]].tobytes() for j in range(p, p + k))
            out.append({"lang": words.langs[words.lang[p]], "phrase": text.decode("utf-8", "replace"), "key": int(key.view(np.int64)[i]),
                        "a": times, "l": int(lefts[i]), "r": int(rights[i]), "score": int(scores[cut[i], i]),
                        "absorbs": [int(x[i]) for x, t in inner if 100 * times >= absorb_percent * int(t[i])]})
    return out


def collocations(docs: DataFrame, *, first: int = FIRST, absorb_percent: int = ABSORB_PERCENT, scale: int = SCALE,
                 max_words: int = MAX_WORDS, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``first`` phrases (2 to ``max_words`` words, as frequent as
    ``mine`` asks) by score descending, number descending, phrase, without those that a longer one absorbs.

    a, l, r: numbers of the phrase and of the two parts of its lowest-scoring cut; n: of all words of the language.
    """
    chunks, known, _ = _mined(docs, max_words=max_words, **options)
    fields = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("key", pa.int64()), ("a", pa.int64()), ("l", pa.int64()),
                        ("r", pa.int64()), ("score", pa.int64()), ("absorbs", pa.list_(pa.int64())), ("n", pa.int64())])

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return fields.empty_table()
        return pa.Table.from_pylist(_scored(_words_of(rows["rows"][0].as_buffer()), Have.of(known), max_words, absorb_percent, scale), schema=fields)

    scored = written(chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, PHRASE), "collocations")
    sizes = scored.filter("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    absorbed = scored.select(F.explode("absorbs").alias("key")).distinct()
    left = scored.filter("phrase is not null").drop("n", "absorbs").join(absorbed, "key", "left_anti").drop("key")
    placed = with_positions(left, ["lang", F.desc("score"), F.desc("a"), "phrase"])
    # a language's rows follow one another; rows up to its first ones are few, the languages' starts a row each
    starts = placed.groupBy("lang").agg(F.min("position").alias("start"), F.count("*").alias("n"))
    ranked = spread_join(placed, starts, "lang", "position", placed.count()).withColumn(
        "rank", (F.col("position") - F.col("start") + 1).cast("long")).filter(F.col("rank") <= first)
    return ranked.drop("n").join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:], w[4:])) AS g FROM worded),
grams AS (
  SELECT lang, 1 AS k, g[1] AS phrase FROM places
  UNION ALL SELECT lang, 2, g[1] || ' ' || g[2] FROM places WHERE g[2] IS NOT NULL
  UNION ALL SELECT lang, 3, g[1] || ' ' || g[2] || ' ' || g[3] FROM places WHERE g[3] IS NOT NULL
  UNION ALL SELECT lang, 4, g[1] || ' ' || g[2] || ' ' || g[3] || ' ' || g[4] FROM places WHERE g[4] IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, j, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM c, (VALUES (1), (2), (3)) AS cut(j), f x, f y
  WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ones AS (
  SELECT lang, a, unnest(list_transform([p for p in [[1, 2], [2, 2], [3, 2], [1, 3], [2, 3]] if p[2] < k AND p[1] + p[2] - 1 <= k],
                                        lambda p: array_to_string(w[p[1]:p[1] + p[2] - 1], ' '))) AS phrase FROM c),
absorbed AS (
  SELECT DISTINCT p.lang, p.phrase FROM inner_ones q JOIN c p ON p.lang = q.lang AND p.phrase = q.phrase WHERE 100 * q.a >= 80 * p.a),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b ANTI JOIN absorbed d ON d.lang = b.lang AND d.phrase = b.phrase)
SELECT r.lang, rank, phrase, a, l, r.r, n, score::BIGINT AS score FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE rank <= 2000
"""
