"""Language-model scoring by Katz backoff.

Counts: n-grams of the training texts up to ``order`` (2 or 3), over lower-cased words, one
end and, as history only, one start per text. Discounts: Good-Turing with Katz's correction
for counts up to 5, per order. Every n-gram of the training texts is in the model, those seen
once too, with d(1). One more count than its own is given to every history, so what never
followed it keeps some mass:

    P(w | h) = d(c) c / (count(h) + 1)         for c = count(h w) >= 1
    P(w | h) = alpha(h) P(w | shorter h)       else
    alpha(h) = (1 - sum of the former) / (1 - sum of P(w | shorter h) over the same w)

The lowest order gives all unseen words together, as one type, the discounted mass. So each
history's probabilities add up to 1 over the vocabulary and that type, and a token is evaluated
recursively from the longest history down.

Every order is two rounds of packed keys (``opsdeck.llm.exchange``): all chunks send their
distinct n-grams with training counts and get the corpus counts back; then the one chunk that a
bucket names as the owner of an n-gram sends the numbers that make its terms of its history's sums,
and a chunk gets the weights of those histories that it backs off from (training texts never do;
so counting needs no weights, and the weights of order 2 go with the counts of order 3). An n-gram is
sent only if both n-grams one shorter are in the model (else it can't be). Counts and weights are
stored, packed by key range, in a table partitioned by kind and order next to the scores.

A round is a job that asks and ``PARTS`` that answer, each for a part of the buckets; what a job
shuffled is freed when it ends, and what was asked when it is answered. Between them, questions
and answers wait in tables of the shared checkpoint folder. So disk holds one round at a time.

Defined results: a null or empty text is one end token; rows with a null id belong to the
training part; without training rows all tokens are unknown with base and model probability 1
each; repeated rows are texts of their own and count again. Two n-grams of an order >= 2 are
taken for one if 48 bits and the key range agree (about one in 10**9), words if 56 do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import InitVar, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdeck.llm import exchange
from opsdeck.llm.words import Texts, window_hashes
from opsdeck.session import ensure_checkpoint_dir

ORDER = 3
CUT = 1  # smallest count of an n-gram of the model
#: Larger chunks than elsewhere share more n-grams, so fewer keys travel.
CHUNK_BYTES = 8 << 20
PARTS = 4  # in which a round is answered
TOP = 5  # largest count that is discounted
START, END = np.uint64(0x6C62272E07BB0142), np.uint64(0x62B821756295C58D)
MODEL = "bucket int, n_buckets int, keys binary, values binary"
ROUND = f"kind string, {MODEL}, chunk int, payload binary"  # what a round writes: answers, a part of the model, totals
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def key_bytes(k: int) -> int:
    """Bytes of a key that tell it apart within its bucket, at least."""
    return 7 if k == 1 else 6


def short(k: int, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Keys without the low bits that aren't needed beside the bucket's range; in the same order."""
    return keys >> np.uint64(max(0, 64 - 8 * key_bytes(k) - n_buckets.bit_length()))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps, byte by byte; only the high bytes can be compressed."""
    steps = np.diff(keys)
    size = (int(steps.max(initial=0)).bit_length() + 7) // 8
    planes = [np.ascontiguousarray(x).tobytes() for x in steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T]
    return _frame([keys[:1].tobytes(), *planes[:-2], *(_squeezed(x) for x in planes[-2:])])


def unpack_keys(blob: bytes) -> np.ndarray:
    first, *planes = _unframe(blob)
    first = np.frombuffer(first, dtype=np.uint64)
    if not planes:
        return first
    planes = [*planes[:-2], *map(_whole, planes[-2:])]
    steps = np.zeros((len(planes[0]) + 1, 8), dtype=np.uint8)
    for i, x in enumerate(planes):
        steps[1:, i] = np.frombuffer(x, dtype=np.uint8)
    steps = steps.view("<u8").ravel()
    steps[0] = first[0]
    return np.cumsum(steps, dtype=np.uint64)


def discounts(n: dict[int, float], top: int = TOP) -> np.ndarray:
    """d[c] for counts up to ``top`` (d[0] is 0) from the numbers of n-grams seen 1..top+1 times.

    Katz's formula; where the counts of counts are too uneven for it, absolute discounting with
    Ney's estimate.
    """
    d = np.ones(top + 1)
    d[0] = 0.0
    n = [0.0, *(float(n.get(r, 0)) for r in range(1, top + 2))]
    if all(n[1:]) and n[1] > (top + 1) * n[top + 1]:
        a = (top + 1) * n[top + 1] / n[1]
        for r in range(1, top + 1):
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
    if not all(0 < x < 1 for x in d[1:]):
        b = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        for r in range(1, top + 1):
            d[r] = (r - b) / r if b < 1 or r > 1 else 0.5
    return d


@dataclass
class Discounted:
    """What a chunk knows of one order: discounts, and for order 1 the scale and unseen mass."""

    d: np.ndarray
    scale: float = 1.0
    unseen: float = 0.0

    def times(self, c: np.ndarray) -> np.ndarray:
        """d(c) c."""
        return np.where(c <= TOP, self.d[np.minimum(c, TOP)] * c, c)


def first_order(totals: dict) -> Discounted:
    n = totals.get("tokens", 0)
    if not n:
        return Discounted(np.zeros(TOP + 1), 0.0, 1.0)
    d = discounts({r: totals.get(str(r), 0) for r in range(1, TOP + 2)})
    mass = n - sum((1 - d[r]) * r * totals.get(str(r), 0) for r in range(1, TOP + 1))
    unseen = max(1 - mass / n, 1 / (n + 1))
    return Discounted(d, (1 - unseen) / mass, unseen)


def higher_order(totals: dict) -> Discounted:
    return Discounted(discounts({r: totals.get(str(r), 0) for r in range(1, TOP + 2)}))


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, and which one each is; by a hash table, so that only the distinct ones are sorted."""
    coded = pa.array(hashes).dictionary_encode()
    keys = coded.dictionary.to_numpy()
    order = np.argsort(keys)
    place = np.empty(len(keys), dtype=np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    return keys[order], place[coded.indices.to_numpy()]


def first_places(which: np.ndarray, n: int) -> np.ndarray:
    """Where each of the numbers below ``n`` comes first, without a sort; all of them occur."""
    out = np.empty(n, dtype=np.int64)
    out[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # the last one written stays
    return out


def grouped(numbers: np.ndarray) -> np.ndarray:
    """The stable order of small numbers: numbers and places are sorted as one, which is faster."""
    return np.sort(numbers.astype(np.int64) << 32 | np.arange(len(numbers))) & 0xFFFFFFFF


@dataclass
class Chunk:
    """The texts of a chunk as one sequence: start, words, end of each, and its n-grams.

    ``index[k][p]`` numbers the k-gram that begins at p among the chunk's distinct ones
    (``keys[k]``, sorted), or is -1 if it can't be in the model.
    """

    texts: InitVar[Texts]
    train: np.ndarray
    order: int
    index: dict[int, np.ndarray] = field(default_factory=dict)
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    at: dict[int, np.ndarray] = field(default_factory=dict)
    counts: dict[int, np.ndarray] = field(default_factory=dict)
    needed: dict[int, np.ndarray] = field(default_factory=dict)
    alphas: dict[int, np.ndarray] = field(default_factory=dict)
    parts: dict[int, Discounted] = field(default_factory=dict)
    totals: dict[int, dict] = field(default_factory=dict)

    def __post_init__(self, texts: Texts):
        n = len(texts.n_words)
        self.size = texts.n_words + 2
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.small = np.int32 if self.first[-1] < 2 ** 31 else np.int64
        self.doc = np.repeat(np.arange(n, dtype=self.small), self.size)
        self.sequence = np.empty(self.first[-1], dtype=np.uint64)
        self.sequence[np.arange(len(texts.hashes)) + 2 * texts.doc + 1] = texts.hashes
        self.sequence[self.first[:-1]] = START
        self.sequence[self.first[1:] - 1] = END
        self.left = np.repeat(self.first[1:].astype(self.small), self.size) - np.arange(len(self.doc), dtype=self.small)
        self.trained = self.train[self.doc]

    def add_order(self, k: int) -> None:
        """Number the k-grams; counts of the order below must be known."""
        if k == 1:
            at = np.arange(len(self.sequence), dtype=self.small)
            self.keys[k], which = numbered(self.sequence)
        else:
            below, count = self.index[k - 1], self.counts[k - 1]
            good = (below >= 0) & (np.append(count, 0)[below] >= CUT)
            at = np.flatnonzero((self.left[:-1] >= k) & good[:-1] & good[1:]).astype(self.small)
            hashes = window_hashes(self.sequence, at, k) if len(at) else np.zeros(0, np.uint64)
            self.keys[k], which = np.unique(hashes, return_inverse=True)
        self.index[k] = np.full(len(self.sequence), -1, dtype=self.small)
        self.index[k][at] = which
        self.at[k] = at

    def own_counts(self, k: int) -> np.ndarray:
        at = self.at[k][self.trained[self.at[k]]]
        return np.bincount(self.index[k][at], minlength=len(self.keys[k]))

    def known(self, k: int) -> np.ndarray:
        """Corpus count of the k-gram at each place, 0 where it is none of the model."""
        return np.append(self.counts[k], 0)[self.index[k]]

    def backed_off(self, k: int) -> np.ndarray:
        """Which of the distinct (k-1)-grams are in the model and followed, somewhere in the chunk, by what never followed
        them in training: whose weights it needs."""
        at = np.flatnonzero(~self.trained & (self.left >= k))
        history, gram = self.index[k - 1][at], self.index[k][at]
        at = at[(np.append(self.counts[k - 1], 0)[history] >= CUT) & (np.append(self.counts[k], 0)[gram] < CUT)]
        out = np.zeros(len(self.keys[k - 1]), dtype=bool)
        out[self.index[k - 1][at]] = True
        return out

    def owned(self, k: int) -> np.ndarray:
        """A place of each k-gram that the chunk owns."""
        place = np.zeros(len(self.own), dtype=self.small)
        place[self.index[k][self.at[k]]] = self.at[k]
        return place[self.own & (self.counts[k] >= CUT)]

    def sent_histories(self, k: int, owned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which (k-1)-grams the chunk owns n-grams of, or needs the weights of; and the latter."""
        needed, out = self.backed_off(k), np.zeros(len(self.keys[k - 1]), dtype=bool)
        out[self.index[k - 1][self.owned(k) if owned is None else owned]] = True
        return out | needed, needed

    def probabilities(self, order: int) -> np.ndarray:
        """P of the token at each place by histories of up to order - 1 tokens (starts: 1)."""
        c = self.counts[1]  # of words: worked out once for each
        p = np.where(c > 0, self.parts[1].times(c) * self.parts[1].scale, self.parts[1].unseen)[self.index[1]]
        for k in range(2, order + 1):
            history, c, gram = self.index[k - 1], self.known(k - 1), self.known(k)
            weight = np.ones(len(self.keys[k - 1]) + 1)  # of training texts, too: they never back off
            weight[:-1][self.needed[k]] = self.alphas[k]
            back = weight[history]
            # from the n-gram's begin to its last token
            begin, to = slice(max(0, len(p) - (k - 1))), slice(k - 1, None)
            whole = self.left[begin] >= k
            seen = self.parts[k].times(gram[begin]) / (c[begin] + 1)
            better = np.where(gram[begin] >= CUT, seen, back[begin] * p[to])
            p = np.concatenate((p[:k - 1], np.where(whole, better, p[to])))
        return p


def _pack(counts: np.ndarray) -> bytes:
    """Counts, nearly all of them small, in little space."""
    large = counts[counts >= 255].astype(np.int64)
    return _frame([_squeezed(np.minimum(counts, 255).astype(np.uint8).tobytes()), _squeezed(large.tobytes())])


def _numbers(blob: bytes) -> np.ndarray:
    small, large = map(_whole, _unframe(blob))
    counts = np.frombuffer(small, dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, dtype=np.int64)
    return counts


def _pack_bytes(numbers: np.ndarray) -> bytes:
    """Numbers of 0 and more, byte by byte."""
    size = (int(numbers.max(initial=0)).bit_length() + 7) // 8
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T
    return len(numbers).to_bytes(8, "little") + _frame([_squeezed(np.ascontiguousarray(x).tobytes()) for x in planes])


def _unpack_bytes(blob: bytes) -> np.ndarray:
    out = np.zeros((int.from_bytes(blob[:8], "little"), 8), dtype=np.uint8)
    for i, x in enumerate(_unframe(blob[8:])):
        out[:, i] = np.frombuffer(_whole(x), dtype=np.uint8)
    return out.view("<i8").ravel()


def _squeezed(blob: bytes) -> bytes:
    return len(blob).to_bytes(4, "little") + pa.compress(blob, codec="zstd", asbytes=True) if blob else b""


def _whole(blob: bytes) -> bytes:
    return pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True) if blob else b""


def _frame(blobs: list[bytes]) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], dtype=np.int64).tobytes() + b"".join(blobs)


def _unframe(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob[:8], dtype=np.int64)[0])
    size = np.frombuffer(blob[8:8 * (n + 1)], dtype=np.int64)
    at = 8 * (n + 1) + np.concatenate(([0], np.cumsum(size)))
    return [blob[a:b] for a, b in zip(at, at[1:], strict=False)]


def _merged(keys: list[bytes], extras: list[bytes]):
    """Distinct keys of a bucket, their counts over all chunks, which key each row's are, and where the rows end."""
    parts = [unpack_keys(x) for x in keys]
    distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(which, np.concatenate([_numbers(e) for e in extras]), len(distinct)).astype(np.int64)
    return distinct, total, which, np.cumsum([len(p) for p in parts])[:-1]


def _totals(k: int, distinct: np.ndarray, total: np.ndarray, n_buckets: int) -> dict:
    if k == 1:
        total = total[distinct != short(1, np.array([START]), n_buckets)]
    found = {"tokens": total.sum(), "types": (total > 0).sum()}
    return {str(x): int(n) for x, n in (found | {r: (total == r).sum() for r in range(1, TOP + 2)}).items()}


def _count(k: int, keys, extras, n_buckets: int, parts: dict[int, Discounted]) -> tuple[list[bytes], bytes, bytes, dict]:
    """Answers (the counts, and whether the chunk owns the n-gram, as the first one that has it), the model's keys and
    counts, and totals."""
    distinct, total, which, cuts = _merged(keys, extras)
    own = np.zeros(len(which), dtype=bool)
    own[first_places(which, len(distinct))] = True
    own &= (total >= CUT)[which]
    answers = [_frame([_pack(total[w]), _squeezed(exchange.pack_bits(o))])
               for w, o in zip(np.split(which, cuts), np.split(own, cuts), strict=True)]
    some = total >= CUT
    return answers, pack_keys(distinct[some]), _pack(total[some]), _totals(k, distinct, total, n_buckets)


def _weigh(k: int, keys, extras, n_buckets: int, parts: dict[int, Discounted]) -> tuple[list[bytes], bytes, bytes, dict]:
    """Answers (weights of the histories that a chunk needs), and the model's histories and weights."""
    sent, frames = [unpack_keys(x) for x in keys], [_unframe(e) for e in extras]
    distinct, which = np.unique(np.concatenate(sent), return_inverse=True)
    needed = np.concatenate([exchange.unpack_bits(_whole(f[0]), len(p)) for p, f in zip(sent, frames, strict=True)])
    followers, times, *terms = (np.concatenate([_unpack_bytes(f[i]) for f in frames]) for i in range(1, len(frames[0])))
    upper = parts[k].times(terms[0]) / (np.repeat(times, followers) + 1)
    lower = parts[k - 1].times(terms[1])
    lower = lower * parts[1].scale if k == 2 else lower / (terms[2] + 1)
    history = np.repeat(which, followers)
    sums = [np.bincount(history, x, len(distinct)) for x in (upper, lower)]
    alpha = np.maximum(1 - sums[0], 0) / np.maximum(1 - sums[1], 1e-300)
    cuts = np.cumsum([len(p) for p in sent])[:-1]
    answers = [alpha[w[n]].tobytes() for w, n in zip(np.split(which, cuts), np.split(needed, cuts), strict=True)]
    some = alpha != 1.0
    return answers, pack_keys(distinct[some]), alpha[some].tobytes(), {}


def _answered(tasks: list[tuple[str, int]], asked: DataFrame, n_buckets: int, first: int, parts: dict[int, Discounted]) -> DataFrame:
    """A round's answers, its parts of the model (sorted keys and their counts or weights) and totals, by bucket; each
    task of the round has ``n_buckets`` of its own."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        bucket = rows["bucket"][0].as_py()
        kind, k = tasks[bucket // n_buckets]
        answers, keys, values, totals = (_count if kind == "count" else _weigh)(
            k, rows["keys"].to_pylist(), rows["extra"].to_pylist(), n_buckets, parts)
        out = [{"kind": "answer", "bucket": bucket + first, "chunk": c, "payload": a}
               for c, a in zip(rows["chunk"].to_pylist(), answers, strict=True)]
        out.append({"kind": kind, "bucket": bucket % n_buckets, "n_buckets": n_buckets, "keys": keys, "values": values})
        out.append({"kind": "total", "bucket": bucket, "payload": json.dumps(totals).encode()})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("kind", pa.string()), ("bucket", pa.int32()), ("n_buckets", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()),
            ("chunk", pa.int32()), ("payload", pa.binary())]))

    return asked.groupBy("bucket").applyInArrow(run, ROUND)


def _looked_up(asked: DataFrame, stored: DataFrame, kind: str, k: int, first: int) -> DataFrame:
    """Answers from a stored model, in the form in which training gives them."""
    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        counts = kind == "count"
        known = unpack_keys(model["keys"][0].as_py()) if model.num_rows else np.zeros(0, np.uint64)
        kept = model["values"][0].as_py() if model.num_rows else None
        kept = np.zeros(0) if kept is None else _numbers(kept) if counts else np.frombuffer(kept, dtype=np.float64)
        value = np.append(kept, 0 if counts else 1).astype(np.int64 if counts else np.float64)
        out = []
        for c, b, raw in zip(*(rows[n].to_pylist() for n in ("chunk", "bucket", "keys")), strict=True):
            wanted = unpack_keys(raw)
            at = np.searchsorted(known, wanted)
            hit = at < len(known)
            hit[hit] = known[at[hit]] == wanted[hit]
            found = value[np.where(hit, at, len(known))]
            none = _squeezed(exchange.pack_bits(np.zeros(len(wanted), bool)))
            payload = _frame([_pack(found), none]) if counts else found.tobytes()
            out.append({"chunk": c, "bucket": b + first, "note": False, "payload": payload})
        return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("note", pa.bool_()),
                                                           ("payload", pa.binary())]))

    part = stored.filter((F.col("kind") == kind) & (F.col("order") == k)).select("bucket", "keys", "values")
    return asked.groupBy("bucket").cogroup(part.groupBy("bucket")).applyInArrow(run, exchange.ANSWER)


def _summed(rows: DataFrame) -> dict[str, int]:
    """Totals over all buckets, from a JSON of each; the driver gets a number per name."""
    parts = rows.select(F.explode(F.from_json(F.col("payload").cast("string"), "map<string,long>")).alias("name", "n"))
    return {r["name"]: r["n"] for r in parts.groupBy("name").agg(F.sum("n").alias("n")).collect()}


def _stored_totals(stored: DataFrame, k: int) -> dict[str, int]:
    """The totals of a stored model's counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(_totals(k, unpack_keys(r["keys"]), _numbers(r["values"]), r["n_buckets"])).encode() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["payload"])

    part = stored.filter((F.col("kind") == "count") & (F.col("order") == k))
    return _summed(part.select("n_buckets", "keys", "values").mapInArrow(run, "payload binary"))


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """Jobs that write in here give their shuffles' disk back when they end; the session's setting is as before then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Rounds:
    """Where the rounds of a training run write: the model at ``path``, answers beside it until ``clear``."""

    spark: SparkSession
    path: str
    n: int = 0

    def add(self, rows: DataFrame, kind: str, order: int) -> None:
        """Scores or a part of the model, with all columns of the table."""
        columns = [f for f in f"{SCORES}, {MODEL}".split(", ")]
        have = [F.col(c.split()[0]) if c.split()[0] in rows.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns]
        with _shuffles_freed(self.spark):
            rows.select(*have, F.lit(kind).alias("kind"), F.lit(order).alias("order")).write.mode("append").partitionBy(
                "kind", "order").parquet(self.path)

    def done(self, asked: DataFrame, answered: Callable[[DataFrame], DataFrame], tasks: list[tuple[str, int]],
             n_buckets: int) -> tuple[DataFrame, dict[str, int]]:
        """Run a round: its answers and the totals of what it counted."""
        self.n += 1
        path, parts = f"{self.path}-round-{self.n}", min(PARTS, n_buckets)
        with _shuffles_freed(self.spark):
            asked.withColumn("part", F.col("bucket") % parts).write.partitionBy("part").parquet(f"{path}-asked")
            for i in range(parts):
                rows = self.spark.read.schema(f"{exchange.REQUEST}, part int").parquet(f"{path}-asked").filter(F.col("part") == i)
                answered(rows.drop("part")).write.mode("append").partitionBy("kind").parquet(path)
                self.empty(f"{path}-asked/part={i}")
        found = self.spark.read.schema(ROUND).parquet(path)
        for kind, order in tasks:
            self.add(found.filter(F.col("kind") == kind), kind, order)
            self.empty(f"{path}/kind={kind}")
        return (found.filter("kind = 'answer'").select("chunk", "bucket", F.lit(False).alias("note"), "payload"),
                _summed(found.filter("kind = 'total'")))

    def empty(self, path: str) -> None:
        self.spark.createDataFrame([], ROUND.partition(", ")[2]).write.mode("overwrite").parquet(path)

    def clear(self) -> None:
        for i in range(1, self.n + 1):
            self.empty(f"{self.path}-round-{i}")


def _plan(docs: DataFrame, held_out: Column, id_col: str, text_col: str, order: int, sizes: exchange.Layout | None,
          stored: DataFrame | None = None, rounds: Rounds | None = None) -> DataFrame:
    """Scores, after the rounds of a training run. With a stored model the same rounds look its
    tables up instead of adding up counts, in one plan that shares its shuffles."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sizes = sizes or exchange.layout(rows, "text", CHUNK_BYTES)
    chunks = exchange.packed(exchange.chunked(rows, [F.col("doc_id"), F.col("text")], sizes.n_chunks))
    sort, n_buckets = ["doc_id", "text"], sizes.n_buckets

    def restore(table: pa.Table, back: exchange.Answers | None, done: list[tuple[str, int]]) -> Chunk:
        """The chunk with all that the rounds done so far have told it."""
        chunk = Chunk(Texts(table["text"].to_pylist(), lower=True), ~np.array(table["held_out"].to_pylist(), dtype=bool), order)
        payloads = iter(back.payloads if back else ())

        def told(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
            sent = np.diff(exchange.ranges(keys, n_buckets))
            sent = sent[sent > 0]
            return [next(payloads) for _ in sent], sent

        for what, j in done:
            if what == "count":
                chunk.add_order(j)
                blobs, sent = told(chunk.keys[j])
                parts = [_unframe(p) for p in blobs]
                chunk.counts[j] = np.concatenate([np.zeros(0, np.int64), *(_numbers(p[0]) for p in parts)])
                chunk.own = np.concatenate([np.zeros(0, bool), *(exchange.unpack_bits(_whole(p[1]), n)
                                                                 for p, n in zip(parts, sent, strict=True))])
                chunk.totals[j] = totals[j]
                chunk.parts[j] = known[j]
            else:
                sent, chunk.needed[j] = chunk.sent_histories(j)
                blobs, _ = told(chunk.keys[j - 1][sent])
                chunk.alphas[j] = np.concatenate([np.zeros(0), *(np.frombuffer(b, dtype=np.float64) for b in blobs)])
        return chunk

    def count(k: int, chunk: Chunk, to: exchange.Requests, first: int) -> None:
        chunk.add_order(k)
        counts = chunk.own_counts(k)
        to.send(chunk.keys[k], lambda keys: pack_keys(short(k, keys, n_buckets)), lambda p: _pack(counts[p]), first)

    def weigh(k: int, chunk: Chunk, to: exchange.Requests, first: int) -> None:
        place, size = chunk.owned(k), len(chunk.keys[k - 1])
        history = chunk.index[k - 1][place]
        sent, needed = chunk.sent_histories(k, place)
        place = place[grouped(history)]
        followers, needed, times = np.bincount(history, minlength=size)[sent], needed[sent], chunk.counts[k - 1][sent]
        cuts = np.concatenate(([0], np.cumsum(followers)))
        # of the n-gram, of what is left without its first word, and (for the latter's probability) of its history
        terms = [chunk.known(k)[place], chunk.known(k - 1)[place + 1], *([chunk.known(k - 2)[place + 1]] if k > 2 else [])]
        to.send(chunk.keys[k - 1][sent], lambda keys: pack_keys(short(k - 1, keys, n_buckets)),
                lambda p: _frame([_squeezed(exchange.pack_bits(needed[p])), _pack_bytes(followers[p]), _pack_bytes(times[p]),
                                  *(_pack_bytes(x[cuts[p.start]:cuts[p.stop]]) for x in terms)]), first)

    def asking(tasks: list[tuple[str, int]], told: list[tuple[str, int]]):
        def make(table, back, to: exchange.Requests) -> None:
            chunk = restore(table, back, told)
            for i, (kind, k) in enumerate(tasks):
                (count if kind == "count" else weigh)(k, chunk, to, i * n_buckets)

        return make

    def scored(table: pa.Table, back: exchange.Answers) -> pa.Table:
        chunk = restore(table, back, done)
        p = chunk.probabilities(order)
        n, types = chunk.totals[1].get("tokens", 0), chunk.totals[1].get("types", 0)
        token = np.ones(len(p), dtype=bool)
        token[chunk.first[:-1]] = False
        c = chunk.known(1)
        base = np.where(token, np.log10((chunk.counts[1] + 1) / (n + types + 1))[chunk.index[1]], 0.0)
        docs_n = table.num_rows
        add = lambda v: np.bincount(chunk.doc, v, minlength=docs_n)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": table["held_out"],
            "n_tokens": pa.array(chunk.size - 1, pa.int64()),
            "n_known": pa.array(add(token & (c > 0)).astype(np.int64), pa.int64()),
            "train_tokens": pa.array(np.full(docs_n, n), pa.int64()),
            "base_score": pa.array(add(base), pa.float64()),
            "score": pa.array(add(np.where(token, np.log10(p), 0.0)), pa.float64()),
        })

    back, done, totals, known = [], [], {}, {}

    def union(kinds: tuple[str, ...]) -> DataFrame | None:
        out = None
        for (kind, _), rows in zip(done, back, strict=True):
            if kind in kinds:
                out = rows if out is None else out.union(rows)
        return out

    def learn(tasks: list[tuple[str, int]]) -> None:
        """A round: what it asks, and the answers; they are put in the order of the tasks."""
        first = len(done) * n_buckets
        asked = exchange.requests(chunks, sort, n_buckets, asking(tasks, [d for d in done if d[0] == "count"]), union(("count",)), compressed=True)
        if stored is None:
            parts = dict(known)
            new, found = rounds.done(asked, lambda rows: _answered(tasks, rows, n_buckets, first, parts), tasks, n_buckets)
        else:
            (kind, k), = tasks
            new, found = _looked_up(asked, stored, kind, k, first), _stored_totals(stored, k) if kind == "count" else {}
        for i, (kind, k) in enumerate(tasks):
            if kind == "count":
                totals[k] = found
                known[k] = first_order(found) if k == 1 else higher_order(found)
            done.append((kind, k))
            begin = first + i * n_buckets
            back.append(new.filter((F.col("bucket") >= begin) & (F.col("bucket") < begin + n_buckets)) if len(tasks) > 1 else new)

    if stored is None:
        passes = [[("count", 1)], [("count", 2)], *([("weight", k - 1), ("count", k)] for k in range(3, order + 1)), [("weight", order)]]
    else:
        passes = [[("count", 1)], *([x] for k in range(2, order + 1) for x in (("count", k), ("weight", k)))]
    for tasks in passes:
        learn(tasks)
    return exchange.finish(chunks, union(("count", "weight")), sort, scored, SCORES, compressed=True)


def train_and_score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                    path: str | None = None, sizes: exchange.Layout | None = None) -> DataFrame:
    """Learn from the rows that are not held out, score all: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams) and score, log10 probabilities of whole texts.

    Scores and model are written to ``path`` (a new folder in the shared checkpoint folder if
    None), partitioned by kind (``score``, ``count``, ``weight``) and order.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/katz-{uuid.uuid4().hex}"
    rounds = Rounds(spark, path)
    rounds.add(_plan(docs, held_out, id_col, text_col, order, sizes, rounds=rounds), "score", order)
    rounds.clear()
    names = [c.split()[0] for c in SCORES.split(", ")]
    return spark.read.schema(f"{SCORES}, {MODEL}, kind string, order int").parquet(path).filter("kind = 'score'").select(*names)


def score(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of other documents by the model that ``train_and_score`` stored at ``path``."""
    stored = docs.sparkSession.read.parquet(path).filter("kind <> 'score'")
    made = stored.agg(F.max("order").alias("order"), F.max("n_buckets").alias("n")).first()
    if made["order"] is None:
        raise ValueError(f"no model at {path}")
    sizes = exchange.Layout(exchange.layout(docs, text_col, CHUNK_BYTES).n_chunks, made["n"])
    return _plan(docs, F.lit(True), id_col, text_col, made["order"], sizes, stored)


def query(spark, sf_dir: str) -> DataFrame:
    """Held out: documents whose crc32(doc_id) mod 7 is 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return train_and_score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)
