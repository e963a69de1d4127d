import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import make_docs, with_clashes
from pyspark.sql import functions as F

from opsdeck.llm import line_dedup

BLANKS = " \t\n\v\f\r"


def key(line):
    return line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, min_docs=3, min_chars=20):
    """rows: (id, text); per row (n_lines, n_dropped, text)."""
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max((x for x in ids if x is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def texts_of_lines(seed, n=60, vocabulary=25):
    rng = random.Random(seed)
    pool = [f"line number {k} of the pool, long enough" for k in range(vocabulary)] + [
        "ÉCOLE ÉLÉMENTAIRE ÀÀ", "École élémentaire àà", "日本語の長い行であるはずのもの、二十文字", "short", "x" * 19, "y" * 20, "Z" * 20]
    texts = [None, "", "\n", "   \n\t\n"]
    while len(texts) < n:
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 8))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", "  \v"]) for x in lines]
        texts.append("\n".join(lines) + rng.choice(["", "\n"]))
    return texts


def result(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_dropped, r.text or "") for r in df.collect())


def expected(rows, **options):
    return sorted((i is not None, i or 0, n, gone, text) for i, n, gone, text in brute(rows, **options))


@pytest.mark.parametrize("seed,min_docs,min_chars,vocabulary", [(1, 3, 20, 25), (2, 2, 20, 8), (3, 5, 1, 4), (4, 3, 20, 400)])
def test_against_brute_force(spark, seed, min_docs, min_chars, vocabulary):
    texts = texts_of_lines(seed, vocabulary=vocabulary)
    docs = with_clashes(make_docs(spark, texts)).withColumn("key", F.lit("x")).withColumn("keep", F.lit(1))
    out = line_dedup.dedup_lines(docs, min_docs=min_docs, min_chars=min_chars)
    assert result(out) == expected(list(enumerate(texts)), min_docs=min_docs, min_chars=min_chars)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == docs.columns


def test_null_shared_and_repeated_ids(spark):
    texts = texts_of_lines(5, n=50, vocabulary=10)
    rows = [(None if k % 7 == 0 else k // 2, t) for k, t in enumerate(texts)]
    rows += rows[10:20]                       # rows that repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(line_dedup.dedup_lines(docs)) == expected(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_a_line_of_every_document_and_a_very_long_text(spark):
    hot = "the one line that everybody has in their text"
    texts = [f"{hot}\nown line of document {k}, which stays here" for k in range(400)]
    texts.append("\n".join([hot, "other line of the very long document"] * 20_000))
    texts += [hot] * 3
    docs = make_docs(spark, texts, parts=7)
    assert result(line_dedup.dedup_lines(docs)) == expected(list(enumerate(texts)))
    spread = line_dedup.lines_of(docs, "doc_id", "text", 20).repartitionByRange(8, "key", F.desc("doc_id"), "row", "pos")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / 8   # half of all lines are two hashes


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_partitions_and_batches_cut_anywhere(size):
    """The stream's verdicts, with the edges joined by hand, for any cut into partitions and batches."""
    rng = random.Random(size)
    rows = sorted({(rng.randrange(6), rng.choice([None, *range(6)]), 0, rng.randrange(3)) for _ in range(120)},
                  key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2], r[3]))
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
    dropped, waiting, edges = set(), [], {}
    borders = sorted(rng.sample(range(1, len(rows)), min(size, 20)))
    for a, b in zip([0, *borders], [*borders, len(rows)], strict=True):
        state = line_dedup.Stream(3)
        out = []
        for at in range(a, b, size):
            part = rows[at:min(at + size, b)]
            cols = [[bytes([r[0]]) * 16 for r in part], *([r[c] for r in part] for c in (1, 2, 3)), [3] * len(part)]
            out += line_dedup._judge(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema), state)
        out += line_dedup._edge(state, schema)
        for r in (r for batch in out for r in batch.to_pylist()):
            line = (r["key"][0], r["doc_id"], r["row"], r["pos"])
            if r["kind"] == 0:
                dropped.add(line)
            elif r["kind"] == 1:
                waiting.append(line)
            else:
                edges.setdefault(r["key"][0], set()).add(r["doc_id"])
    dropped |= {x for x in waiting if len(edges[x[0]]) >= 3 and x[1] != max(d for d in edges[x[0]] if d is not None)}
    held = {}
    for k, d, *_ in rows:
        held.setdefault(k, set()).add(d)
    assert dropped == {r for r in rows if len(held[r[0]]) >= 3 and r[1] != max(d for d in held[r[0]] if d is not None)}


def test_bitmaps(spark):
    same = "a line that four documents have in common"
    docs = make_docs(spark, [f"{same}\nx\n{same.upper()}", same, f"\n{same}", f"y\n {same}\n{same}"])
    got = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs).collect()}
    assert sorted(got) == [0, 1, 2]            # the largest id keeps its lines
    bits = {i: np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines).tolist() for i, r in got.items()}
    assert bits == {0: [0, 1, 0], 1: [0], 2: [1, 0]} and [got[i].n_dropped for i in range(3)] == [2, 1, 1]
