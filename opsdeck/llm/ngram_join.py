"""Near duplicates: a prefix-tree join of word n-gram sets by Jaccard similarity.

1. Documents with equal sets become one class, named by its smallest id.
2. How many classes hold each n-gram gives the global order: rare n-grams first. Two sets of
   similarity t share one of their first ``n - ceil(t n) + 1`` n-grams (their prefix), and an
   n-gram that one class alone holds is shared by nobody. Most sets have only such n-grams in
   their prefix; they are done. The others, without those n-grams and in global order, are
   written to a table.
3. Such sets are stored in prefix trees. A probing set walks down a
   tree; sets with a common beginning share the overlap counted so far, and a subtree is left
   when the longest rest below it, or its set sizes, cannot reach the similarity any more.
4. Sets that share a popular n-gram lie together: a set's *home* is the smallest class that holds
   the most popular n-gram of its prefix; small homes share a place, large ones are cut into places
   of bounded bytes. So the near copies of one text meet in a few places, however many chunks of
   documents they came from.
5. Which set probes which place: first, for each prefix n-gram, the class with the largest share of
   shared n-grams probes every place that has the n-gram. Links found make components. An n-gram
   whose classes are one component needs nothing more; for any other, every class outside its
   largest component probes every place that has it, if sizes and positions allow a link: with r
   shared n-grams from the common one on, a set of n n-grams has links through it only with sets of
   at most ``r (1 + t) / t - n`` n-grams (the first n-gram that two sets share is one for which that
   holds both ways). So each pair that shares a prefix n-gram is either compared, or already
   connected, or can't be a link: no link between components is missed, a group of thousands of
   near copies costs a few probes a member, no pairs within a group are emitted, and texts that
   share a boilerplate too short for a link don't visit one another.
6. The probes of a place are dealt over blocks of bounded size, each a task with the place's tree.
   Joins by n-gram, class or home spread the rows of hot keys (at most ``components.MOST_HOT``,
   counted, so that the list of them may be broadcast).

Defined results: texts of fewer words than n have one n-gram, the whole sequence; null or
empty texts, and texts without words, have none and are linked with nothing (their component
is their own id); rows that share an id are one document; rows with a null id take no part and
get a null component.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdeck.llm import exchange
from opsdeck.llm.common import fresh
from opsdeck.llm.components import connected, salted_join, spread_join, written
from opsdeck.llm.substring_dedup import _distinct
from opsdeck.llm.words import Texts, mix

N = 5
PERCENT = 75
KEY_BYTES = 5
BLOCK_BYTES = 16 << 20  # of the sets of a place, and of probing sets that meet them in one task
STEP = 64  # n-grams compared between two looks at the bounds


@dataclass
class Sets:
    """The n-gram sets of several texts: ``grams[first[i]:first[i + 1]]``, sorted."""

    grams: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set."""
        out = []
        for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.concatenate(([np.uint64(0)], np.cumsum(mix(self.grams ^ np.uint64(seed)), dtype=np.uint64)))
            out.append(mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64)))
        return out[0], out[1]


def sets_of(texts: list[bytes | None], n: int = N) -> Sets:
    words = Texts(texts, lower=True)
    at, gram = words.windows(n)
    doc = words.doc[at]
    short = np.flatnonzero((words.n_words > 0) & (words.n_words < n))
    whole = [words.window_hashes(words.first[[i]], int(words.n_words[i]))[0] for i in short]
    if len(short):
        gram, doc = np.concatenate((gram, np.array(whole, dtype=np.uint64))), np.concatenate((doc, short))
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return Sets(gram, np.searchsorted(doc, np.arange(len(texts) + 1)))


def _run_end(rows: list, i: int, end: int, at: int) -> int:
    """Where the run of rows ends that have the same n-gram as row i at a place."""
    gram, high = rows[i][1][at], end
    low = i + 1
    while low < high:
        middle = (low + high) // 2
        if rows[middle][1][at] == gram:
            low = middle + 1
        else:
            high = middle
    return low


class Tree:
    """A prefix tree of sets, given as sequences in one global order."""

    __slots__ = ("part", "below", "ends", "least", "most", "depth")

    def __init__(self, rows: list[tuple[bytes, list[int], int, int]]):
        """Rows (order key, sequence, set size, name) sorted by key."""
        todo, made = [(self, 0, len(rows), 0)], []
        while todo:
            node, i, end, at = todo.pop()  # its rows agree before ``at``
            first, last = rows[i][1], rows[end - 1][1]
            to = at
            while to < len(first) and to < len(last) and first[to] == last[to]:
                to += 1
            node.part, node.ends, node.below = first[at:to], [], []  # part: what all sequences below share next
            while i < end and len(rows[i][1]) == to:
                node.ends.append((rows[i][2], rows[i][3]))
                i += 1
            while i < end:
                j = _run_end(rows, i, end, to)
                node.below.append(Tree.__new__(Tree))
                todo.append((node.below[-1], i, j, to))
                i = j
            made.append(node)
        for node in reversed(made):  # children first
            sizes = [s for s, _ in node.ends]
            node.least = min([*sizes, *(c.least for c in node.below)])
            node.most = max([*sizes, *(c.most for c in node.below)])
            node.depth = len(node.part) + max([0, *(c.depth for c in node.below)])  # longest rest from the start of ``part``

    def probe(self, grams: frozenset, size: int, percent: int, found: list, shared: int = 0) -> None:
        """Append the names of all sets at least ``percent`` similar to one of ``size`` n-grams,
        of which ``grams`` can be shared; ``shared`` were on the way here."""
        stack = [(self, shared)]
        while stack:
            node, shared = stack.pop()
            if 100 * node.most < percent * size or percent * node.least > 100 * size:
                continue
            # the least overlap any set below needs
            need = -(-percent * (size + max(node.least, -(-percent * size // 100))) // (100 + percent))
            part, rest, i = node.part, node.depth, 0
            while i < len(part) and shared + min(rest, len(grams) - shared) >= need:
                piece = part[i:i + STEP]
                shared += len(grams.intersection(piece))
                rest -= len(piece)
                i += STEP
            if i < len(part) or shared + min(rest, len(grams) - shared) < need:
                continue
            for other, name in node.ends:
                if 100 * shared >= percent * (size + other - shared):
                    found.append(name)
            stack += [(child, shared) for child in node.below]


def prefix_size(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes + (-percent * sizes // 100) + 1


def _members(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, sizes: exchange.Layout | None) -> DataFrame:
    """One row per document: id, set size, class; for the classes that may have links, at one
    of their documents, the shared n-grams in global order and how many are in the prefix."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sizes = sizes or exchange.layout(docs, "text")
    chunks = exchange.chunked(docs, [F.col("doc_id"), F.col("text")], sizes.n_chunks)
    order, n_buckets = ["doc_id", "text"], sizes.n_buckets

    def named(rows: pa.Table):
        """The sets, the rows that take part, and the distinct sets among those."""
        sets = sets_of(rows["text"].to_pylist(), n)
        ids = rows["doc_id"].to_numpy(zero_copy_only=False)
        part = np.flatnonzero((sets.sizes > 0) & ~np.isnan(ids.astype(float)))
        ids = np.where(np.isnan(ids.astype(float)), 0, ids).astype(np.int64) if rows["doc_id"].null_count else ids
        one, two = (x[part] for x in sets.names())
        return sets, ids, part, one, two, *_distinct(one, two)

    def classes(rows: pa.Table, _, to: exchange.Requests) -> None:
        _, ids, part, one, two, by, starts, run = named(rows)
        # rows are in order of id, so the first of a run has the smallest
        some = by[starts]
        to.send(one[some], 8, lambda p: two[some][p].tobytes() + ids[part[some]][p].astype(np.int64).tobytes())

    def smallest(keys: list[bytes], extras: list[bytes]) -> list[bytes]:
        """The smallest id of each set, and whether this chunk has it (the first chunk if more do)."""
        one = [exchange.unpack(k, 8) for k in keys]
        both = [np.frombuffer(e, dtype=np.uint64).reshape(2, -1) for e in extras]
        first, second = np.concatenate(one), np.concatenate([b[0] for b in both])
        ids = np.concatenate([b[1] for b in both]).view(np.int64)
        _, starts, run = _distinct(first, second)
        order = np.lexsort((np.arange(len(ids)), ids, run))
        winner = order[np.concatenate(([0], np.flatnonzero(np.diff(run[order])) + 1))]
        out, own = ids[winner][run], np.zeros(len(ids), dtype=bool)
        own[winner] = True
        cuts = np.cumsum([len(o) for o in one])[:-1]
        return [i.tobytes() + exchange.pack_bits(o) for i, o in zip(np.split(out, cuts), np.split(own, cuts), strict=True)]

    def spread(sets: Sets, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of the chosen sets, and the set of each."""
        size = sets.sizes[chosen]
        first = sets.first[chosen] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(chosen) else np.zeros(0, np.int64)
        return sets.grams[np.repeat(first, size) + np.arange(size.sum())], np.repeat(np.arange(len(chosen)), size)

    def frequencies(rows: pa.Table, back: exchange.Answers, to: exchange.Requests) -> None:
        sets, ids, part, one, two, by, starts, run = named(rows)
        at = exchange.ranges(one[by[starts]], n_buckets)
        found, own = [], []
        for payload, m in zip(back.payloads, [x for x in np.diff(at) if x], strict=True):
            found.append(np.frombuffer(payload[: 8 * m], dtype=np.int64))
            own.append(exchange.unpack_bits(payload[8 * m:], m))
        found, own = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((found, np.int64), (own, bool)))
        name = ids.copy()
        name[part] = found[run]
        chosen = np.sort(part[by[starts]][own])
        grams, times = np.unique(spread(sets, chosen)[0], return_counts=True)
        to.send(grams, KEY_BYTES, lambda p: zlib.compress(np.minimum(times[p], 65535).astype(np.uint16).tobytes(), 1))
        mask = np.zeros(len(name), dtype=bool)
        mask[chosen] = True
        to.remember(name.astype(np.int64).tobytes() + exchange.pack_bits(mask))

    def add_up(keys: list[bytes], extras: list[bytes]) -> list[bytes]:
        parts = [exchange.unpack(k, KEY_BYTES) for k in keys]
        distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
        times = np.concatenate([np.frombuffer(zlib.decompress(e), dtype=np.uint16) for e in extras])
        total = np.minimum(np.bincount(which, times, minlength=len(distinct)), 2 ** 32 - 1).astype(np.uint32)[which]
        return [zlib.compress(t.tobytes(), 1) for t in np.split(total, np.cumsum([len(p) for p in parts])[:-1])]

    def reduce(rows: pa.Table, back: exchange.Answers) -> pa.Table:
        sets = sets_of(rows["text"].to_pylist(), n)
        size, count = sets.sizes, rows.num_rows
        name = np.frombuffer(back.notes[0][: 8 * count], dtype=np.int64)
        chosen = np.flatnonzero(exchange.unpack_bits(back.notes[0][8 * count:], count))
        grams, of = spread(sets, chosen)
        distinct, which = np.unique(grams, return_inverse=True)
        times = exchange.Answers([zlib.decompress(p) for p in back.payloads], []).numbers("uint32")
        times = times[which] if len(distinct) else np.zeros(0, np.uint32)
        by = np.lexsort((grams, times, of))
        by = by[times[by] > 1]
        cut = np.searchsorted(of[by], np.arange(len(chosen) + 1))
        shared: list[bytes | None] = [None] * count
        prefix = np.zeros(count, dtype=np.int64)
        prefix[chosen] = prefix_size(size[chosen], percent) - (size[chosen] - np.diff(cut))
        for k, i in enumerate(chosen):
            if prefix[i] > 0:
                shared[i] = grams[by[cut[k]:cut[k + 1]]].tobytes()
        none = np.array([not v for v in rows["doc_id"].is_valid().to_pylist()], dtype=bool)
        return pa.table({"chunk": rows[exchange.CHUNK], "doc_id": rows["doc_id"], "n_shingles": pa.array(size, pa.int64()),
                         "class_id": pa.array(name, pa.int64(), mask=none), "prefix": pa.array(prefix, pa.int64()),
                         "grams": pa.array(shared, pa.binary())})

    named_classes = exchange.answer(exchange.requests(chunks, order, n_buckets, classes), smallest)
    counted = exchange.answer(exchange.requests(chunks, order, n_buckets, frequencies, named_classes), add_up)
    return exchange.finish(chunks, counted, order, reduce,
                           "chunk int, doc_id long, n_shingles long, class_id long, prefix long, grams binary")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, class_id, size, most) of the n-grams in prefixes; ``most`` is the size of the largest
    set that can be linked with this one if the n-gram is the first that they share."""
    def run(batches):
        for batch in batches:
            for name, size, prefix, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = np.frombuffer(raw, dtype=np.int64)
                grams = shared[:prefix]
                most = (len(shared) - np.arange(len(grams))) * (100 + percent) // percent - size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams), pa.array(np.full(len(grams), name, dtype=np.int64)),
                     pa.array(np.full(len(grams), size, dtype=np.int64)), pa.array(most.astype(np.int64))],
                    names=["gram", "class_id", "size", "most"])

    return sets.select("class_id", "n_shingles", "prefix", "grams").mapInArrow(run, "gram long, class_id long, size long, most long")


def _fits(size: str, most: str, least_there: str, most_there: str):
    return (F.col(least_there) <= F.col(most)) & (F.col(size) <= F.col(most_there))


def _shared(postings: DataFrame, n_postings: int) -> DataFrame:
    """The postings whose n-gram lies in two prefixes at least, with its number of them (``n``),
    smallest class (``least``) and, as ``hub``, the class that has the largest ``most`` for its size."""
    stats = postings.groupBy("gram").agg(
        F.count("*").alias("n"), F.min("class_id").alias("least"),
        F.max(F.struct((F.col("most") / F.col("size")).alias("share"), "class_id", "size", "most")).alias("hub")).filter("n > 1")
    return spread_join(postings, stats, "gram", "class_id", n_postings)


def _placed(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(class_id, place) of the sets that share a prefix n-gram with another."""
    homes = shared.groupBy("class_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "least")).alias("top"))
    homes = homes.select("class_id", F.col("top.least").alias("home"))
    homes = written(homes.join(sets.select("class_id", F.octet_length("grams").alias("bytes")), "class_id"), "homes")
    total, count = homes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    bins = max(1, -(-total // BLOCK_BYTES))
    sizes = homes.groupBy("home").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("parts"), F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("class_id"), F.col("parts"))
    place = F.when(F.col("parts") > 1, F.xxhash64("home", part)).otherwise(F.pmod(F.xxhash64("home"), F.lit(bins)))
    return spread_join(homes, sizes, "home", "class_id", count).select("class_id", place.alias("place"))


def _there(shared: DataFrame) -> DataFrame:
    """Of each prefix n-gram and place the smallest set and the largest ``most``."""
    return shared.groupBy("gram", "place").agg(F.min("size").alias("least_there"), F.max("most").alias("most_there"))


def _first(shared: DataFrame, there: DataFrame) -> DataFrame:
    """(class_id, place) of the probes by the hub of each n-gram."""
    hubs = shared.groupBy("gram").agg(F.first("hub").alias("hub"), F.count("*").alias("n"))
    hubs = hubs.select("gram", "n", "hub.class_id", "hub.size", "hub.most")
    return spread_join(there, hubs, "gram", "place", shared.count()).filter(
        _fits("size", "most", "least_there", "most_there")).select("class_id", "place").distinct()


def _second(shared: DataFrame, there: DataFrame, labels: DataFrame) -> DataFrame:
    """(class_id, place) of the probes by n-grams whose classes are not one component yet."""
    counts = shared.groupBy("class_id").agg(F.count("*").alias("n"))
    named = counts.join(labels, "class_id", "left").select("class_id", "n", F.coalesce("label", "class_id").alias("label"))
    rows, count = shared.select("gram", "class_id", "size", "most"), shared.count()
    labelled = written(spread_join(rows, named, "class_id", "gram", count).select(*rows.columns, "label"), "labelled")
    split = labelled.groupBy("gram", "label").agg(F.count("*").alias("n")).groupBy("gram").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")).filter("labels > 1")
    split = written(split.select("gram", "n", F.col("top.label").alias("main")), "split")
    movers = spread_join(labelled, split, "gram", "class_id", count).filter("label <> main").select(*rows.columns)
    movers = written(movers, "movers")
    places = written(spread_join(there, split.select("gram", "n"), "gram", "place", count).drop("n"), "split-places")
    # many places of an n-gram times many movers of it: both sides are plain rows, hot n-grams are salted
    counts = movers.groupBy("gram").agg(F.count("*").alias("n"))
    return spread_join(movers, counts, "gram", "class_id", movers.count(), also=places).filter(
        _fits("size", "most", "least_there", "most_there")).select("class_id", "place").distinct()


def _probes(sets: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(place, block, probe, size, probe_grams) of the visits, dealt over blocks of about
    ``BLOCK_BYTES``, and the number of blocks of each place that is visited."""
    visits = written(visits.select(F.col("class_id").alias("probe"), "place"), "visits")
    asking = sets.select(F.col("class_id").alias("probe"), F.col("n_shingles").alias("size"), F.col("grams").alias("probe_grams"))
    counts = visits.groupBy("probe").agg(F.count("*").alias("n"))
    asking = asking.join(counts, "probe")
    weights = asking.select("probe", "n", F.octet_length("probe_grams").alias("bytes"))
    n_visits = visits.count()
    weighed = spread_join(visits, weights, "probe", "place", n_visits)
    blocks = weighed.groupBy("place").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"), F.count("*").alias("n"))
    dealt = spread_join(visits, blocks, "place", "probe", n_visits).select(
        "probe", "place", F.pmod(F.xxhash64("probe"), "blocks").cast("int").alias("block"))
    return spread_join(dealt, asking, "probe", "place", n_visits).drop("n"), blocks.select("place", "blocks")


def _links(sets: DataFrame, visits: DataFrame, percent: int) -> DataFrame:
    """Links that the visits (class_id, place) find, at most one per set and block of a place:
    in a block, sets that one another's links already connect are linked once. ``sets`` have a place."""
    probes, blocks = _probes(sets, visits)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if rows.num_rows and asked.num_rows:
            stored = [(raw, np.frombuffer(raw, dtype=np.uint64).tolist(), size, name)
                      for raw, size, name in zip(*(rows[c].to_pylist() for c in ("grams", "n_shingles", "class_id")), strict=True)]
            tree = Tree(sorted(stored, key=lambda r: r[0]))
            for name, size, raw in zip(*(asked[c].to_pylist() for c in ("probe", "size", "probe_grams")), strict=True):
                found: list[int] = []
                tree.probe(frozenset(np.frombuffer(raw, dtype=np.uint64).tolist()), size, percent, found)
                for other in found:
                    a, b = sorted((top(name), top(other)))
                    root[b] = a
        out = [(x, top(x)) for x in list(root)]
        out = [x for x in out if x[0] != x[1]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    # the sets of a place are bounded, so a place is no hot key here
    stored = sets.select("place", "class_id", "n_shingles", "grams").join(blocks.hint("merge"), "place")
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return stored.groupBy("place", "block").cogroup(probes.groupBy("place", "block")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                    sizes: exchange.Layout | None = None) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set) and component_id (smallest id
    reachable by links) of every document.

    Intermediate tables go to the shared checkpoint folder.
    """
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("percent must be in 1..100 and n positive")
    members = written(_members(docs, id_col, text_col, n, percent, sizes), "members")
    sets = members.filter(F.col("grams").isNotNull()).select("class_id", "n_shingles", "prefix", "grams")
    postings = written(_postings(sets, percent), "postings")
    shared = written(_shared(postings, postings.count()), "shared")
    placed = written(_placed(shared, sets), "placed")
    sets = written(sets.join(placed, "class_id").select("place", "class_id", "n_shingles", "grams"), "sets")
    shared = written(shared.join(placed, "class_id").select("gram", "class_id", "size", "most", "hub", "place"), "placed-postings")
    there = written(_there(shared), "places")
    first = written(_first(shared, there), "first")
    links = written(_links(sets, first, percent), "links")
    # n-grams whose classes are not one component yet
    labels = written(connected(links), "labels").withColumnRenamed("node", "class_id")
    second = _second(shared, there, labels)
    more = _links(sets, second.join(first, ["class_id", "place"], "left_anti"), percent)
    labels = written(connected(links.union(more)), "labels")
    out = salted_join(members.select("doc_id", "n_shingles", "class_id"), labels.withColumnRenamed("node", "class_id"),
                      "class_id", "doc_id", "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null ids last), then
    hash of the text, then row number.

    Every row takes part as a document of its own, under the number it gets in a table written
    first: rows that repeat or share an id, and rows without one.
    """
    key = fresh(docs, "row_number")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(key, text_col), id_col=key, text_col=text_col, **options)
    found = found.select(F.col("doc_id").alias(key), "component_id")
    ranked = rows.select(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                                       F.xxhash64(text_col).alias("text"), F.col(key).alias("key")).alias("rank"))
    kept = found.join(ranked, key).groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.key").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS words, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
windows AS (
  SELECT doc_id, words, i, string_agg(word, ' ') OVER ahead AS gram, count(*) OVER ahead AS n FROM places
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
grams AS (SELECT DISTINCT doc_id, gram FROM windows WHERE n = 5 OR (i = 1 AND words < 5)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
           GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, coalesce(l.other, t.doc_id)) AS component_id
FROM texts t LEFT JOIN sizes s ON t.doc_id = s.doc_id LEFT JOIN least l ON l.node = t.doc_id
"""
