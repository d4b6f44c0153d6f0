"""Vectorised scans of many texts at once: words, lines and their hashes as numpy arrays over one buffer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _tables(seed: int) -> tuple[np.ndarray, int]:
    draw = np.random.Generator(np.random.PCG64(seed))
    table = draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table, int(draw.integers(1, 2**63)) * 2 + 1


#: A random odd number for each byte value, and the odd base of the rolling hash (modulo 2**64).
BYTE, BASE = _tables(20)
POWERS: dict[str, np.ndarray] = {}


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2**64 for i < count."""
    if "up" not in POWERS or len(POWERS["up"]) < count:
        size = max(count, 1 << 21)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            POWERS[name] = np.multiply.accumulate(step)
    return POWERS["up"][:count], POWERS["down"][:count]


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs (from, to, texts) of rows with about `most` bytes together; a longer text is a run of its own. None is empty."""
    at, size, texts = 0, 0, []
    for k, x in enumerate(batch.column(column)):
        text = x.as_py() or b""
        if texts and size + len(text) > most:
            yield at, k, texts
            at, size, texts = k, 0, []
        texts.append(text)
        size += len(text) + 1
    if texts:
        yield at, at + len(texts), texts


PART = 1 << 20  # a text of so many bytes is scanned part by part


def parts(text: bytes, ends: np.ndarray, most: int = PART) -> Iterator[tuple[int, int, bool]]:
    """(from, to, whole) of runs of less than `most` bytes that each end after one of the bytes of the table `ends`.

    An item between two such bytes that has `most` bytes or more is a run of its own: whole is true for it, wherever it
    stands. So the same item is always scanned in the same way."""
    view, at = np.frombuffer(text, np.uint8), 0
    while at < len(view):
        if len(view) - at < most:
            yield at, len(view), False
            return
        inside = np.flatnonzero(ends[view[at : at + most]])
        if len(inside):
            stop = at + int(inside[-1]) + 1
            yield at, stop, False
        else:
            stop = at + most
            while stop < len(view) and not len(found := np.flatnonzero(ends[view[stop : stop + most]])):
                stop += most
            stop = min(stop + int(found[0]), len(view)) if stop < len(view) else len(view)
            yield at, stop, True
        at = stop


def digest_hash(item: bytes | memoryview) -> int:
    """The 64-bit hash of an item of PART bytes or more."""
    return int.from_bytes(hashlib.blake2b(item, digest_size=8).digest(), "little")


class Scan:
    """Texts in one buffer, each ended by a line feed, with the places of their words and hashes of any span."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.bytes = LOWER[self.raw] if lower else self.raw
        self.count = len(texts)
        self.starts = np.zeros(self.count + 1, np.int64)
        np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, self.count), out=self.starts[1:])
        space = SPACES[self.raw]
        edge = np.flatnonzero(np.diff(space, prepend=True))  # starts and ends in turn: the buffer ends with a space
        self.word_start, self.word_end = edge[::2], edge[1::2]
        self.space = space
        self.word_doc = np.searchsorted(self.starts, self.word_start, "right") - 1
        self.n_words = np.bincount(self.word_doc, minlength=self.count)
        up, self.down = powers(len(self.raw) + 1)
        self.sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(BYTE[self.bytes] * up[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans, equal for equal bytes wherever they stand."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def by_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte over each text."""
        return np.add.reduceat(flags, self.starts[:-1], dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
