"""Vectorised word splitting and hashing for tasks that see a block of texts.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D`` in the UTF-8
form (those bytes never occur inside a multi-byte character, so this equals splitting on
the characters). Words are identified by a 64-bit hash; windows of words by one or two
polynomial hashes over the word hashes. Everything is array arithmetic modulo 2**64: no
Python loop runs per word.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)          # odd, = 1 mod 4 is avoided on purpose below
_WORD_P = np.uint64(0xD1B54A32D192ED03)     # multiplier of bytes in a word (3 mod 4)
WINDOW_P = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))  # of words in a window
_BLOCK = 1 << 18
_PIECE = 1 << 17  # bytes split at once, so that their 64-bit numbers stay in a core's cache
_SHORT = 8  # windows of up to so many words are added up word by word, without tables of powers
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _inverse(p: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(p, -1, 1 << 64)


def powers(p: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**0..p**n and their inverses modulo 2**64, kept for later calls."""
    have = _powers.get(int(p))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, _BLOCK + 64)

        def run(base: int) -> np.ndarray:
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            return np.cumprod(out)

        have = (run(int(p)), run(_inverse(int(p))))
        if size <= 4 * _BLOCK:
            _powers[int(p)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits (a bijection)."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    part = out >> np.uint64(27)
    out ^= part
    out *= np.uint64(0x94D049BB133111EB)
    out ^= np.right_shift(out, np.uint64(31), out=part)
    return out


def _block_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    inside = int(len(buf) > 0 and not space[0])  # then the first edge ends a word; starts and ends alternate
    starts, ends = edge[inside::2], edge[1 - inside::2]
    if inside:
        starts = np.concatenate(([0], starts))
    if len(buf) and not space[-1]:
        ends = np.concatenate((ends, [len(buf)]))
    up, down = powers(_WORD_P, len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    part = total[1:]  # worked on in place
    part[:] = buf
    part += np.uint64(1)
    part *= up[: len(buf)]
    np.cumsum(part, out=part)
    h = (total[ends] - total[starts]) * down[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * _P)


def split_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a byte array, worked off in blocks that end
    at white space (a longer word makes a longer block)."""
    if len(buf) <= _PIECE:
        return _block_words(buf)
    cuts, at = [0], 0
    while at < len(buf):
        to = min(at + _PIECE, len(buf))
        while to < len(buf) and not _IS_SPACE[buf[to]]:
            step = np.flatnonzero(_IS_SPACE[buf[to:to + _PIECE]])
            to = to + int(step[0]) if len(step) else min(to + _PIECE, len(buf))
        cuts.append(to)
        at = to
    parts = [_block_words(buf[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return tuple(np.concatenate([p[i] + (a if i < 2 else 0) for p, a in zip(parts, cuts, strict=False)])
                 for i in range(3))


class Texts:
    """The words of several texts, one after another.

    ``hashes``/``starts``/``ends`` hold every word (byte positions in ``buf``);
    ``first[i]:first[i + 1]`` are the words of text i. Null texts have no words.
    """

    def __init__(self, texts: list[str | bytes | None], lower: bool = False):
        raw = [t.encode("utf-8", "replace") if isinstance(t, str) else (t or b"") for t in texts]
        buf = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        size = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        self.starts, self.ends, self.hashes = split_words(buf)
        self.first = np.searchsorted(self.starts, self.begin)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.n_words)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text begin here (itself included)."""
        return np.repeat(self.first[1:], self.n_words) - np.arange(len(self.hashes))

    def windows(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that start a window of n words inside one text, and the
        windows' hashes (family ``which``)."""
        at = np.flatnonzero(self.left() >= n)
        return at, self.window_hashes(at, n, which)

    def window_hashes(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """Hashes of the windows of n words that start at the given words."""
        if not len(at):
            return np.zeros(0, dtype=np.uint64)
        return window_hashes(self.hashes, at, n, which)


def window_hashes(hashes: np.ndarray, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    if n <= _SHORT:  # the same sum of hash * p**i
        out = hashes[at]
        for i in range(1, n):
            part = hashes[i:][at]
            part *= np.uint64(pow(int(WINDOW_P[which]), i, 1 << 64))
            out += part
        return mix(out)
    up, down = powers(WINDOW_P[which], len(hashes))
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[at + n] - total[at]) * down[at])
