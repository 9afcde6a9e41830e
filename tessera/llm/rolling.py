"""Rolling hashes over the bytes of Arrow string columns, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ASCII white space by byte.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; does it occur earlier."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


class Rolling:
    """Hashes of byte spans as differences of prefix sums of random values times powers of an odd base, modulo 2**64."""

    def __init__(self, fold: np.ndarray | None = None):
        """fold: the byte that each byte counts as."""
        self.value = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        if fold is not None:
            self.value = self.value[fold]
        self.up = self.down = np.ones(1, np.uint64)

    def over(self, b: np.ndarray):
        """A function of span starts and ends in b that gives their hashes."""
        size = len(b)
        if len(self.up) <= size:
            self.up, self.down = powers(_BASE, size + 1), powers(_INVERSE, size + 1)
        prefix = np.zeros(size + 1, np.uint64)
        np.cumsum(self.value[b] * self.up[:size], out=prefix[1:])
        return lambda s, e: mix((prefix[e] - prefix[s]) * self.down[s] + (e - s).astype(np.uint64))


def runs(inner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of inner bytes; none crosses the edge of a text."""
    edge = np.zeros(len(inner) + 1, bool)
    edge[starts] = edge[ends] = True
    before, after = np.concatenate([[False], inner[:-1]]), np.concatenate([inner[1:], [False]])
    return np.flatnonzero(inner & (edge[:-1] | ~before)), np.flatnonzero(inner & (edge[1:] | ~after)) + 1


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column, null as empty, without a copy of the texts."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes in all; a longer text is a run of its own."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to
