"""Token counts by a finite-state tokenizer.

The vocabulary of a byte-level BPE tokenizer is compiled, lazily, into a deterministic
transducer over characters. Its transitions carry the change of the token count, so counting
is one table step per character and no token is ever built.

* Inside one pre-token the state after a prefix holds, for each of the prefix's suffixes that
  still is the beginning of some token, the last token before that suffix and how far the
  count there lies behind. Reading a byte extends those suffixes; exactly one of them becomes
  a token that BPE accepts beside its left neighbour (two tokens are neighbours in some BPE
  result exactly when merging their joint bytes gives these two back).
* Around it stands the automaton of the split pattern: runs of letters, numbers, other
  characters and white space, the white space before a word, and the contractions. White space
  and apostrophes look ahead; their states count as if the text ended and correct themselves.

A text of many bytes is cut into chunks. After a visible character and a blank the state is
the same whatever came before, so a chunk's map of entry states to (exit state, count) is
constant beyond its head: it is kept as head, count in between, and tail. Two neighbouring
maps compose by counting tail + head, which is associative; chunks are rows of their own that
can be dealt over all tasks, and a document's maps are composed by pairs, level by level.

Defined results: a null or empty text has 0 tokens; bytes that are not UTF-8 count as U+FFFD;
the added special tokens of the file count 1 wherever their string occurs, as is the
library's default; repeated rows stay apart. The table of states is dropped when it holds
more than ``MAX_STATES``, so memory is bounded; it is rebuilt as needed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdeck.llm.common import fresh

CHUNK_BYTES = 1 << 18
MAX_STATES = 200_000
#: Words whose map from blank to blank is kept.
MAX_WORDS = 500_000
TOKEN_LIMIT = 512
_machines: dict = {}
_SYNC = re.compile(r"\S[ \n]")
_SYNC_BACK = re.compile(r"[ \n]\S")
#: Contractions of the split pattern: second character -> third one, or "" if it is complete.
CONTRACTIONS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The BPE of one pre-token as a transducer over bytes."""

    def __init__(self, vocab: dict[str, int], merges: list):
        of = _byte_alphabet()
        self.rank = {}
        for i, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[bytes(of[c] for c in a), bytes(of[c] for c in b)] = i
        tokens = [bytes(of[c] for c in t) for t in vocab if all(c in of for c in t)]
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in tokens:
            node = 0
            for b in t:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(None)
            self.token[node] = t
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for pair in self.rank:  # in the order of ranks
            self.made.setdefault(pair[0] + pair[1], pair)
        self.forget()

    def forget(self) -> None:
        self.neighbours: dict[tuple[bytes, bytes], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The parts that the token has at its left (0) or right (1) end while it is merged,
        each with the rank of the merge that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            parts, part, until = [], token, float("inf")
            while len(part) > 1:
                parts.append((part, until))
                pair = self.made[part]
                until, part = self.rank[pair], pair[side]
            parts.append((part, until))
            known = self.edges[side][token] = parts[::-1]
        return known

    def beside(self, a: bytes, b: bytes) -> bool:
        """Whether merging the joint bytes of two tokens gives these two back: no merge across
        the border comes before the merges that take up the parts at the border."""
        known = self.neighbours.get((a, b))
        if known is None:
            left, right = self.edge(a, 1), self.edge(b, 0)
            i = j = 0
            known = True
            while True:
                (x, x_until), (y, y_until) = left[i], right[j]
                across = self.rank.get((x, y))
                if across is not None and across < x_until and across <= y_until:
                    known = False
                    break
                if i + 1 == len(left) and j + 1 == len(right):
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.neighbours[a, b] = known
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """Next state and change of the count. A state is a tuple of (trie node, token before
        it or None, count there minus count here); the first state is ``START``."""
        alive, found = [], None
        for node, before, rel in state:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if found is None and token is not None and (before is None or self.beside(before, token)):
                found = token, rel + 1
            if self.children[child]:
                alive.append((child, before, rel))
        if found is None:
            raise ValueError("the vocabulary lacks a byte")
        token, change = found
        return (*((node, before, rel - change) for node, before, rel in alive), (0, token, 0)), change


START = ((0, None, 0),)


class State(dict):
    """A state of the whole transducer: character -> (next state, change of the count)."""

    __slots__ = ("machine", "mode", "data")

    def __missing__(self, char: str):
        self[char] = to = self.machine.build(self.mode, self.data, char)
        return to


class Machine:
    """The transducer of split pattern and merges, built as texts need it.

    Modes: ``fresh`` (a pre-token begins next), ``L``/``N``/``O`` (in a run of letters,
    numbers, others), ``S`` (in white space), ``'`` (an apostrophe that began a pre-token)
    and ``'r``, ``'v``, ``'l`` after it.
    """

    def __init__(self, definition: dict, kind_of):
        model = definition["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        special = [t["content"] for t in definition.get("added_tokens", [])]
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.kind_of = kind_of
        self.kinds: dict[str, str] = {}
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.merges.forget()
        self.fresh = self.state("fresh", None)

    def state(self, mode: str, data) -> State:
        have = self.states.get((mode, data))
        if have is None:
            have = self.states[mode, data] = State()
            have.machine, have.mode, have.data = self, mode, data
        return have

    def kind(self, char: str) -> str:
        known = self.kinds.get(char)
        if known is None:
            known = self.kinds[char] = self.kind_of(char)
        return known

    def read(self, state: tuple, char: str) -> tuple[tuple, int]:
        total = 0
        for byte in char.encode():
            state, change = self.merges.step(state, byte)
            total += change
        return state, total

    def count(self, chars: str) -> int:
        return self.read(START, chars)[1]

    def begin(self, char: str) -> tuple[State, int]:
        """A new pre-token starts with the character."""
        inner, n = self.read(START, char)
        if char == "'":
            return self.state("'", inner), n
        kind = self.kind(char)
        return self.state(kind, (inner, None, char, 0) if kind == "S" else inner), n

    def build(self, mode: str, data, char: str) -> tuple[State, int]:
        if mode == "fresh":
            return self.begin(char)
        kind = self.kind(char)
        if mode == "S":
            return self.after_space(data, char, kind)
        if mode == "'":
            if char in CONTRACTIONS:
                if not CONTRACTIONS[char]:
                    return self.fresh, self.count("'" + char) - self.count("'")
                inner, n = self.read(START, char)
                return self.state("'" + char, inner), n
            mode = "O"
        elif mode in ("'r", "'v", "'l"):
            if char == CONTRACTIONS[mode[1]]:
                return self.fresh, self.count(mode + char) - self.count("'") - self.count(mode[1])
            mode = "L"
        if kind == mode:
            inner, n = self.read(data, char)
            return self.state(mode, inner), n
        return self.begin(char)

    def after_space(self, data: tuple, char: str, kind: str) -> tuple[State, int]:
        run, shorter, last, ahead = data  # the run, the run without its last character, counts' difference
        if kind == "S":
            longer, n = self.read(run, char)
            return self.state("S", (longer, run, char, n)), n
        undo = 0 if shorter is None else self.count(last) - ahead
        # the last white space now stands alone, or before the word if it is a blank
        if last == " ":
            one, _ = self.read(START, " ")
            inner, n = self.read(one, char)
            return self.state(kind, inner), undo + n
        to, n = self.begin(char)
        return to, undo + n

    def run(self, text: str) -> int:
        """Tokens of a text that starts and ends here, one step per character."""
        at, n = self.fresh, 0
        for char in text:
            at, change = at[char]
            n += change
        if len(self.states) > MAX_STATES:
            self.reset()
        return n

    def total(self, text: str) -> int:
        """Tokens of a text that starts and ends here, special strings included."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        From a blank after a visible character to the next such blank the transducer goes from
        one state back to it, so the count of the word between is kept and looked up.
        """
        parts = text.split(" ")
        if len(parts) < 4:
            return self.run(text)
        words = self.words
        known = list(map(words.get, parts))
        n, open_at = 0, 0  # parts from open_at on wait for a blank after a visible character
        last = len(parts) - 1
        for i in range(last):
            word = parts[i]
            if open_at == i and i:
                count = known[i]
                if count is None:
                    count = words.get(word)
                if count is None and word and self.kind(word[-1]) != "S":
                    if len(words) >= MAX_WORDS:
                        words.clear()
                    count = words[word] = self.run(f" {word}")
                if count is not None:
                    n += count
                    open_at = i + 1
            elif word and self.kind(word[-1]) != "S":
                n += self.run((" " if open_at else "") + " ".join(parts[open_at:i + 1]))
                open_at = i + 1
        return n + self.run((" " if open_at else "") + " ".join(parts[open_at:]))

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        """(head, count, tail) of a chunk; (text, 0, None) if no place in it forgets its past.

        The head ends with the first such place's blank, the tail begins with the last one's.
        """
        first = _SYNC.search(text)
        if first is None:
            return text, 0, None
        last = len(text) - _SYNC_BACK.search(text[::-1]).start()
        return text[:first.end()], self.between(text[first.end() - 1:last]), text[last - 1:]

    def between(self, text: str) -> int:
        """Tokens that a text adds after its first character, a blank that stands alone."""
        return self.total(text) - self.total(text[0])

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks (associative)."""
        if a[2] is None and b[2] is None:
            return a[0] + b[0], 0, None
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.between(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """All maps composed, by pairs of neighbours, level by level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def close(self, whole: tuple) -> int:
        """The count of a map whose entry is the start of the text and whose exit is its end."""
        head, n, tail = whole
        return self.total(head) + (n + self.between(tail) if tail is not None else 0)


def machine(tokenizer_file: str) -> Machine:
    """The transducer of a tokenizer file, one in each worker process."""
    if tokenizer_file not in _machines:
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            definition = json.load(f)
        model, before = definition["model"], definition.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or definition.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is compiled")
        cut = Tokenizer.from_file(tokenizer_file).pre_tokenizer.pre_tokenize_str

        def kind_of(char: str) -> str:
            """Which run the library lets the character join."""
            for kind, mate in (("L", "a"), ("N", "1"), ("O", "!")):
                if len(cut(mate + char)) == 1:
                    return kind
            return "S"

        _machines[tokenizer_file] = Machine(definition, kind_of)
    return _machines[tokenizer_file]


def chunk_text(raw: bytes, no: int, of: int, size: int) -> str:
    """The characters that begin in a chunk's first ``size`` bytes; up to 3 bytes more follow."""
    begin, end = 0, min(size, len(raw))
    while no and begin < min(3, len(raw)) and raw[begin] & 0xC0 == 0x80:
        begin += 1
    if no < of - 1:
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
    return raw[begin:end].decode("utf-8", "replace")


def count_tokens(docs: DataFrame, tokenizer_file: str, *, text_col: str = "text", count_col: str = "n_tokens",
                 chunk_bytes: int = CHUNK_BYTES, spread: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, with the text's number of tokens (a column of that
    name is replaced). With ``spread`` the chunks are dealt over all partitions first."""
    keep = [c for c in docs.columns if c not in (text_col, count_col)]
    row, raw, no, of, found = (fresh(docs, n) for n in ("row", "raw", "chunk_no", "n_chunks", "chunk"))

    @F.arrow_udf("struct<head:string,n:long,tail:string>")
    def maps(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = machine(tokenizer_file)
        for chunk, nos, ofs in batches:
            out = []
            for c, k, n in zip(chunk, nos.to_pylist(), ofs.to_pylist(), strict=True):
                text = chunk_text(c.as_py(), k, n, chunk_bytes)
                head, count, tail = (None, m.total(text), None) if n == 1 else m.chunk_map(text)
                out.append({"head": head, "n": count, "tail": tail})
            yield pa.array(out, pa.struct([("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())]))

    @F.arrow_udf("long")
    def totals(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = machine(tokenizer_file)
        for batch in batches:
            out = []
            for parts in batch.to_pylist():
                whole = [(p["head"], p["n"], p["tail"]) for p in parts]
                out.append(whole[0][1] if whole[0][0] is None else m.close(m.scan(whole)))
            yield pa.array(out, pa.int64())

    # a row's chunks come from one task, so its number is theirs alone
    rows = docs.select(F.monotonically_increasing_id().alias(row), *keep,
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(raw))
    rows = rows.withColumn(of, F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / chunk_bytes)).cast("int"))
    chunks = rows.withColumn(no, F.explode(F.sequence(F.lit(0), F.col(of) - 1)))
    # three bytes more, for a character that begins in the chunk
    chunks = chunks.withColumn(raw, _slice(F.col(raw), F.col(no) * chunk_bytes, chunk_bytes + 3))
    if spread:
        chunks = chunks.repartition(F.col(row), F.col(no))
    mapped = chunks.select(row, *keep, no, maps(F.col(raw), F.col(no), F.col(of)).alias(found))
    pair = F.struct(F.col(no).alias("no"), F.col(f"{found}.head").alias("head"), F.col(f"{found}.n").alias("n"),
                    F.col(f"{found}.tail").alias("tail"))
    one = mapped.groupBy(row).agg(*[F.first(c).alias(c) for c in keep], F.sort_array(F.collect_list(pair)).alias(found))
    return one.select(*keep, totals(F.col(found)).alias(count_col))


def _slice(raw: Column, at: Column, n: int) -> Column:
    return F.substring(raw, at + 1, F.lit(n))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")
