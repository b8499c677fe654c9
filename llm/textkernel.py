"""Vectorised byte and word kernels shared by the operators.

A batch of texts is laid out as one byte buffer with a line feed after each text, so that words, word shingles and
fixed-length byte strings of all texts are found with whole-array numpy operations. Words are maximal runs of bytes
other than space and the five control characters from tab to carriage return; no UTF-8 sequence contains those bytes,
so working on bytes and working on characters find the same words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SEED = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * SEED) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the odd base modulo 2**64, and their inverses."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for key, base in (("p", _ODD), ("q", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and its idle memory counts."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # not with this C library


def thrifty(run):
    """A function over batches that gives memory back from time to time and at its end."""

    def wrapped(batches):
        for i, out in enumerate(run(batches)):
            yield out
            if i % 16 == 15:
                release()
        release()

    return wrapped


def encode(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def blocks(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to at most `most` (one longer item stands alone)."""
    start = end = total = 0
    for end, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, end)
            start, total = end, 0
        total += n
    if total or end >= start:
        yield slice(start, end + 1)


class Words:
    """The words of a batch of byte strings.

    text: index of the text of each word; start, end: its bytes in `buffer`; hash: 64 bits of its bytes;
    first: for each text the index of its first word (one more entry than texts).
    """

    def __init__(self, texts: list[bytes], hashes: bool = True):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sep = _SEP[self.buffer]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if not sep[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.offsets = offsets
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        if hashes:
            p, q = powers(len(self.buffer))
            total = np.empty(len(self.buffer) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[self.buffer] * p[: len(self.buffer)], out=total[1:])
            h = (total[self.end] - total[self.start]) * q[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64) * SEED)


_PLACES = mix(np.arange(101, 165, dtype=np.uint64) * SEED) | np.uint64(1)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each run of `width` words; a text of fewer words, but one at least, is one run."""
    n = len(words.hash)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total[: max(0, n - j)] += words.hash[j:] * _PLACES[j]
    full = words.count >= width
    last = words.first[1:] - width
    at = np.arange(n)
    keep = full[words.text] & (at <= last[words.text])
    out = mix(total[keep] + np.uint64(width))
    text, start = words.text[keep], at[keep]
    short = np.flatnonzero((words.count > 0) & ~full)
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = words.count[short] > j
            extra[has] += words.hash[words.first[short[has]] + j] * _PLACES[j]
        extra = mix(extra + words.count[short].astype(np.uint64))
        out, text, start = np.concatenate((out, extra)), np.concatenate((text, short)), np.concatenate((start, words.first[short]))
        order = np.argsort(text, kind="stable")
        out, text, start = out[order], text[order], start[order]
    return out, text, start


def strings(buffer: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from each place of the buffer; the last width - 1 places are left out."""
    n = len(buffer)
    if n < width:
        return np.zeros(0, np.uint64)
    part, size = _BYTE[buffer], 1
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out = part
            else:
                m = len(buffer) - done - size + 1
                out = part[:m] * np.uint64(pow(_ODD, done, 1 << 64)) + out[size : size + m]
            done += size
        if done == width:
            return mix(out[: n - width + 1])
        m = len(part) - size
        part = part[:m] * np.uint64(pow(_ODD, size, 1 << 64)) + part[size : size + m]
        size *= 2
