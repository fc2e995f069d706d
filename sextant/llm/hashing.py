"""Vectorised hashing of the bytes, words and word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers; two hashes with different ones are independent.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Texts are hashed together up to this many bytes; a longer text stands alone.
BATCH = 1 << 19

#: ASCII letters, digits and _, and all bytes of other characters, make words.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """b**i and b**-i modulo 2**64 for i below n, b the base of that number."""
    for sign in (1, -1):
        if len(_powers.get((base, sign), ())) < n:
            p = np.full(max(n, 2 * BATCH), pow(BASES[base], sign, 1 << 64), np.uint64)
            p[0] = 1
            _powers[base, sign] = np.cumprod(p, dtype=np.uint64)
    return _powers[base, 1][:n], _powers[base, -1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Hash of any stretch of a byte string in constant time."""

    def __init__(self, raw: np.ndarray, base: int = 0):
        self.up, self.down = powers(len(raw) + 1, base)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        """Hashes of all stretches of that size, in order."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def batches(rows: Iterable[pa.RecordBatch], lower: bool = False) -> Iterator[tuple[list, list[bytes]]]:
    """(other columns' rows, UTF-8 texts) of about BATCH bytes; the text is the last column."""
    keys: list = []
    texts: list[bytes] = []
    size = 0
    for batch in rows:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            *others, text = [c.to_pylist() for c in part.columns]
            for key, t in zip(zip(*others, strict=True), text, strict=True):
                t = t or ""
                keys.append(key)
                texts.append((t.lower() if lower else t).encode("utf-8", "replace"))
                size += len(texts[-1])
                if size >= BATCH:
                    yield keys, texts
                    keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by a line end, and where each text starts (and the end)."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), starts


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], IN_WORD[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of the first word of each text (and the end)."""
    raw, starts = joined(texts)
    begin, end = word_bounds(raw)
    return Prefixes(raw).of(begin, end), np.searchsorted(begin, starts)


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the index of the first run of each text (and the end).

    A text of fewer than k words, but at least one, is one run.
    """
    words, first = word_hashes(texts)
    odd = powers(k + 1)[0]
    counts = np.diff(first)
    total = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * odd[j + 1]
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    out = np.empty(bounds[-1], np.uint64)
    full = counts >= k
    if full.any():
        at = np.repeat(first[:-1][full] - bounds[:-1][full], runs[full]) + np.concatenate([np.arange(a, b) for a, b in zip(bounds[:-1][full], bounds[1:][full], strict=True)])
        where = at - np.repeat(first[:-1][full] - bounds[:-1][full], runs[full])
        out[where] = mix(total[at])
    for i in np.flatnonzero(~full & (counts > 0)):
        some = words[first[i] : first[i + 1]]
        out[bounds[i]] = mix(np.array([(some * odd[1 : len(some) + 1]).sum(dtype=np.uint64) + np.uint64(len(some))]))[0]
    return out, bounds
