"""Splits many texts into words or lines at once and hashes them, on NumPy byte arrays.

Texts are joined into one byte buffer, so that a batch costs a fixed number of array operations whatever the number
of documents. A piece's hash is multilinear: the sum of each byte times a random odd constant of its position, modulo
2**64, and then a finaliser. Two different pieces collide with a probability of about 2**-56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BLOCK = 4096
_POSITION = _RNG.integers(1, 2**63, _BLOCK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
MULTIPLIERS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: The white space of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts, limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts as UTF-8 with about `limit` bytes (a longer text is a run of its own), and where each starts.

    `texts` is a list or an Arrow column; of a column, 256 values at a time become Python strings.
    """
    run: list[bytes] = []
    size, first = 0, 0
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256] if isinstance(texts, list) else texts.slice(at, 256).to_pylist()
        for i, t in enumerate(part, at):
            b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
            if run and size + len(b) > limit:
                yield first, run
                run, size, first = [], 0, i
            run.append(b)
            size += len(b)
    if run:
        yield first, run


class Pieces:
    """Words or lines of a run of texts: `start`, `end` in `buf`, `doc` (index in the run) and `hash` of each."""

    def __init__(self, run: list[bytes], is_break: np.ndarray = SPACE, fold: np.ndarray | None = LOWER):
        self.raw = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
        self.buf = self.raw if fold is None else fold[self.raw]
        size = np.array([len(b) + 1 for b in run], np.int64)
        self.doc_start = np.cumsum(size) - size
        inside = ~is_break[self.raw]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(before & ~inside)
        self.doc = (np.searchsorted(self.doc_start, self.start, "right") - 1).astype(np.int64)
        self.count = np.bincount(self.doc, minlength=len(run))
        self.first = np.cumsum(self.count) - self.count
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        begin = self.start[0]
        span = np.diff(np.append(self.start, len(self.buf)))
        at = np.arange(begin, len(self.buf)) - np.repeat(self.start, span)
        value = (self.buf[begin:].astype(np.uint64) + np.uint64(1)) * _POSITION[at & (_BLOCK - 1)]
        if (self.end - self.start).max() > _BLOCK:
            turn = [1]
            while len(turn) <= int(at.max()) // _BLOCK:
                turn.append(turn[-1] * _STEP % 2**64)
            value *= np.array(turn, np.uint64)[at // _BLOCK]
        value[~inside[begin:]] = 0
        return mix(np.add.reduceat(value, self.start - begin) + (self.end - self.start).astype(np.uint64))

    def windows(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and first piece of every run of k pieces; with `short`, a document of fewer pieces gives its whole sequence."""
        n = len(self.hash)
        if n >= k:
            h = sum((self.hash[j : n - k + 1 + j] * MULTIPLIERS[j] for j in range(k)), np.zeros(n - k + 1, np.uint64))
            own = self.doc[: n - k + 1] == self.doc[k - 1 :]
            at = np.flatnonzero(own)
            h = mix(h[own])
        else:
            h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if short and len(few := np.flatnonzero((self.count > 0) & (self.count < k))):
            s = self.count[few].astype(np.uint64) * np.uint64(_STEP)
            for j in range(k - 1):
                has = self.count[few] > j
                s[has] += self.hash[self.first[few[has]] + j] * MULTIPLIERS[j]
            h, at = np.concatenate([h, mix(s)]), np.concatenate([at, self.first[few]])
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
        return h, self.doc[at] if len(at) else at, at


def shingle_sets(run: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles (64-bit hashes) of each text in the run."""
    p = Pieces(run)
    h, doc, _ = p.windows(k)
    edge = np.searchsorted(doc, np.arange(len(run) + 1))
    for i in range(len(run)):
        yield np.unique(h[edge[i] : edge[i + 1]])
