"""Words and rolling hashes of many texts at once, as numpy arrays over one Arrow string buffer.

A text is a slice of one shared byte buffer, so the work is a few vector operations per buffer and not a loop per
text. A word's hash holds all bytes of a short word, and is a digest of a long one. Hashes of windows are polynomials
modulo 2^64 over such hashes (or over random byte values), finished by a mixing step; a window's hash comes from two
prefix sums, whatever its length. Over words they are equal by chance alone; over bytes there are long strings that
collide for every base, so byte spans are hashed where bytes are compared afterwards, or where only counts are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are worked on in slices of about this many bytes; arrays of 8 bytes per byte stay small. One text is never cut.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Texts:
    """Texts as one buffer: text i is ``data[offsets[i]:offsets[i + 1]]``; null and empty texts have no bytes."""

    data: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(column: pa.ChunkedArray | pa.Array) -> Texts:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(column, pa.ChunkedArray):  # several chunks remain only beyond 2 GB
            column = pa.chunked_array(column.chunks, pa.large_string()).combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
        return Texts(raw[at[0] : at[-1]], at - at[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def pieces(self, most: int) -> Iterator[tuple[int, Texts]]:
        """Whole texts in pieces of about ``most`` bytes, each with its first text's number: arrays that fit in a cache."""
        sizes = np.diff(self.offsets)
        piece = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)] if len(sizes) else []
        for begin, end in zip(cuts, cuts[1:], strict=False):
            at = self.offsets[begin : end + 1]
            yield begin, Texts(self.data[at[0] : at[-1]], at - at[0])

    def lower(self) -> Texts:
        """A-Z in lower case; all other bytes unchanged."""
        return Texts(_LOWER[self.data], self.offsets)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text in which each byte position lies."""
        return np.searchsorted(self.offsets, at, side="right") - 1


@dataclass(frozen=True)
class Words:
    """Words of texts: start and end bytes, owning text, and the first word of each text (one more entry at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def words(texts: Texts, separator: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that are no separators; a run never crosses texts."""
    data = texts.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(texts) + 1, np.int64))
    gap = separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[texts.offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return Words(starts, ends, texts.owner(starts), np.searchsorted(starts, texts.offsets))


#: A word of so many bytes at most is two numbers as it is; longer ones are digested.
PLAIN_BYTES = 16


def word_digests(texts: Texts, found: Words) -> np.ndarray:
    """Two 64-bit hashes of each word (a row per word), made of its length and all of its bytes.

    Words of up to 16 bytes are two 64-bit numbers already, which are mixed; the few longer ones have a digest, made
    once for each of them that is different.
    """
    sizes = found.ends - found.starts
    padded = np.zeros(len(texts.data) + PLAIN_BYTES, np.uint8)
    padded[: len(texts.data)] = texts.data
    halves = np.lib.stride_tricks.sliding_window_view(padded, PLAIN_BYTES)[found.starts].copy().view("<u8").reshape(-1, 2)
    ones = np.uint64(2**64 - 1)
    for half in (0, 1):  # what lies behind the word is no part of it
        bits = np.clip(8 * (sizes - 8 * half), 0, 64).astype(np.uint64)
        halves[:, half] &= np.where(bits > 0, ones >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0))
    size = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one, two = mix(halves[:, 0] ^ mix(halves[:, 1] + size)), mix(halves[:, 1] ^ mix(halves[:, 0] - size))
    out = np.stack([one, two], axis=1)
    known: dict[bytes, tuple[int, int]] = {}
    for i in np.flatnonzero(sizes > PLAIN_BYTES).tolist():
        word = texts.data[found.starts[i] : found.ends[i]].tobytes()
        if word not in known:
            known[word] = np.frombuffer(hashlib.blake2b(word, digest_size=16).digest(), "<u8")
        out[i] = known[word]
    return out


def slices(table: pa.Table | pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[pa.Table]:
    """The table's rows in pieces of about ``most`` bytes of text, and of ``rows`` rows at most if that is given."""
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    if not table.num_rows:
        return
    sizes = np.diff(Texts.of(table[column]).offsets)
    piece = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), table.num_rows]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        step = rows or max(end - begin, 1)
        for at in range(begin, end, step):
            yield table.slice(at, min(step, end - at))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class RollingHash:
    """Hashes of substrings and of word windows; two of them with different seeds make a 128-bit hash."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = int(rng.integers(2**40, 2**62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.full(size, self.base, np.uint64))
            self.down = np.cumprod(np.full(size, pow(self.base, -1, 2**64), np.uint64))
        return self.up[:n], self.down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(len(values))[0], out=total[1:])
        return total

    def between(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = self.powers(len(prefix))[1]
        return mix((prefix[end] - prefix[begin]) * down[begin])

    def spans(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each byte span."""
        return self.between(self.prefix(self.values[data]), begin, end)

    def windows(self, values: np.ndarray, length: int) -> np.ndarray:
        """A hash of every ``length`` consecutive values (one fewer than ``length`` shorter than ``values``)."""
        n = len(values) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total, down = self.prefix(values), self.powers(len(values))[1]
        return mix((total[length:] - total[:n]) * down[:n])
