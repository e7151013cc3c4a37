"""Vectorised UTF-8 text kernels shared by the operators of this subpackage.

Everything works on Arrow string buffers, a bounded slice of rows at a time, so that
no per-word Python object is made. A slice holds ``CHUNK_BYTES`` of text, or one row
if that row alone is longer: memory is bounded by the longest text, never by a group.

Hashes are chains of a mixing function over blocks of eight bytes (words) and over pairs
of runs of doubling length (n-grams), so that regular sequences meet no more often than
any others: sums modulo 2**64, as in polynomial hashes, would give all Thue-Morse words of
a length one hash. Two keys give 128 bits where equality must be exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Keys of the two hashes: one for words, one for runs of words.
_KEYS = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
#: Longer words are hashed one by one.
_LONG_WORD = 64
_LEFT = np.concatenate([[0], (1 << (8 * np.arange(1, 9, dtype=object))) - 1]).astype(np.uint64)

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of the licence scanner: digits, small letters and everything beyond ASCII.
ALNUM_SEP = np.ones(256, bool)
ALNUM_SEP[0x30:0x3A] = ALNUM_SEP[0x61:0x7B] = ALNUM_SEP[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@dataclass
class Chunk:
    """Rows ``first .. first+len(ends)`` of a batch: their bytes and where each begins and ends."""

    first: int
    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.begins)


def text_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Slices of whole rows with at most ``most`` bytes each (a longer row stands alone)."""
    data, offs = text_rows(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        base = offs[at]
        yield Chunk(at, data[base : offs[to]], offs[at:to] - base, offs[at + 1 : to + 1] - base)
        at = to


@dataclass
class Words:
    """Words of a chunk: byte ranges, and for each row its first word and the one after its last."""

    begin: np.ndarray
    end: np.ndarray
    row_from: np.ndarray
    row_to: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.row_to - self.row_from


def find_words(chunk: Chunk, data: np.ndarray, separator: np.ndarray) -> Words:
    inside = ~separator[data]
    n = len(inside)
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    if n:
        after[-1] = False
    live = chunk.ends > chunk.begins
    before[chunk.begins] = False
    after[chunk.ends[live] - 1] = False
    begin = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after) + 1
    return Words(begin, end, np.searchsorted(begin, chunk.begins), np.searchsorted(begin, chunk.ends))


def word_hashes(data: np.ndarray, words: Words, which: int = 0) -> np.ndarray:
    key = np.uint64(_KEYS[which][0])
    size = words.end - words.begin
    out = mix(size.astype(np.uint64) * key + key)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    on = np.flatnonzero(size <= _LONG_WORD) if size.max(initial=0) > _LONG_WORD else slice(None)
    at, left = words.begin[on], size[on]
    now = out[on]
    while len(at):
        now = mix((now ^ (eight[at] & _LEFT[np.minimum(left, 8)])) * key)
        out[on] = now
        more = np.flatnonzero(left > 8)
        on = more if isinstance(on, slice) else on[more]
        at, left, now = at[more] + 8, left[more] - 8, now[more]
    secret = _KEYS[which][0].to_bytes(8, "little")
    for k in np.flatnonzero(size > _LONG_WORD):
        out[k] = int.from_bytes(blake2b(data[words.begin[k] : words.end[k]], digest_size=8, key=secret).digest(), "little")
    return out


def _joined(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    key = np.uint64(_KEYS[which][1])
    return mix(mix(a * key + key) ^ (b * key))


def gram_hashes(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` hashes, by start; runs over row borders are included. Runs of doubling length are joined."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, run = None, 0, hashes, 1
    while True:
        if n & run:
            out = power[:size] if out is None else _joined(out, power[have : have + size], which)
            have += run
        if have == n:
            return out
        power = _joined(power[:-run], power[run:], which)
        run *= 2


def row_hashes(hashes: np.ndarray, words: Words, which: int = 0) -> np.ndarray:
    """Hash of all words of each row, in order: a sum of words mixed with their places."""
    count = words.count
    place = np.arange(len(hashes)) - np.repeat(words.row_from, count)
    total = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        total[some] = np.add.reduceat(_joined(hashes, mix(place.astype(np.uint64) + np.uint64(1)), which), words.row_from[some])
    return mix(total + count.astype(np.uint64))


def starts_of(words: Words, n: int, size: int) -> np.ndarray:
    """Of ``size`` runs of ``n`` words, which lie within one row."""
    ok = np.zeros(size + 1, np.int64)
    some = words.row_to - n + 1 > words.row_from
    np.add.at(ok, words.row_from[some], 1)
    np.add.at(ok, np.minimum(words.row_to[some] - n + 1, size), -1)
    return np.cumsum(ok[:size]) > 0


def sliding(values: np.ndarray, n: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each run of ``n`` values."""
    out, have = values, 1
    while 2 * have <= n:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    return op(out[: len(out) - (n - have)], out[n - have :]) if n > have else out


def row_of(words: Words, n_words: int) -> np.ndarray:
    """Row of each word."""
    return np.repeat(np.arange(len(words.row_from)), words.row_to - words.row_from)[:n_words]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class HashIndex:
    """Numbers by 64-bit hash (never 0): an open-addressing table in arrays, at most half full."""

    def __init__(self, bits: int):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    @classmethod
    def of(cls, h: np.ndarray) -> HashIndex:
        """Each distinct hash by its place in ``h``."""
        out = cls(max(10, (2 * len(h)).bit_length()))
        out.add(h, np.arange(len(h), dtype=np.int32))
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        on, slot, rest = np.arange(len(h)), (h & np.uint64(self.mask)).view(np.int64), h
        while len(on):
            have = self.keys.take(slot)
            hit = have == rest
            out[on[hit]] = self.values.take(slot[hit])
            go = ~hit & (have != 0)
            on, slot, rest = on[go], slot[go] + 1 & self.mask, rest[go]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not in the table."""
        slot, left = (h & np.uint64(self.mask)).view(np.int64).copy(), np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            got, first = np.unique(slot[left[free]], return_index=True)
            mine = left[free][first]
            self.keys[got] = h[mine]
            self.values[got] = values[mine]
            done = np.zeros(len(h), bool)
            done[mine] = True
            left = left[~done[left]]
            slot[left] = slot[left] + 1 & self.mask
