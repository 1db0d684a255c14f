"""Counting quotient filters of word-id n-grams.

An n-gram of ids of `bits` bits each is permuted invertibly: in rounds, every id is XORed with a mix of the others,
which undoes itself in the reverse order. The permuted value's leading bits are its quotient, all the rest is kept as
its remainder, so a filter is lossless: what it counts can be read back. Entries stand sorted by quotient and remainder.
A filter of one `shard` (the first `split` bits of all its values) is stored compactly: for each quotient the length
of its run, as ones and zeros; the remainders in whole bytes; a byte for each count, and the large counts apart.
Filters of one shard are merged by merging their sorted entries.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from .words import U, mix

HEADER = struct.Struct("<IBBBB")
ROUNDS = 3
#: Odd constants, one for each place of an n-gram.
PLACES = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]
#: Counts from here on are stored apart.
LARGE = 255


def mask(bits: int) -> np.uint64:
    return U((1 << bits) - 1)


def keystream(ids: list[np.ndarray], skip: int, turn: int, bits: int) -> np.ndarray:
    """What the id at `skip` is XORed with in a round: a mix of the ids at the other places."""
    total = np.full(len(ids[0]), (turn * 4 + skip + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1, U)
    for place, other in enumerate(ids):
        if place != skip:
            total = mix(total + other * PLACES[place])
    return total & mask(bits)


def permute(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    ids = [x.astype(U) for x in ids]
    for turn in range(ROUNDS):
        for place in range(len(ids)):
            ids[place] = ids[place] ^ keystream(ids, place, turn, bits)
    return ids


def restore(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    ids = list(ids)
    for turn in reversed(range(ROUNDS)):
        for place in reversed(range(len(ids))):
            ids[place] = ids[place] ^ keystream(ids, place, turn, bits)
    return ids


def packed(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Permuted ids as sort columns: one number if it has room, else one for each place."""
    if len(ids) * bits > 64:
        return ids
    head = np.zeros(len(ids[0]), U)
    for x in ids:
        head = (head << U(bits)) | x
    return [head]


def unpacked(columns: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    if n * bits > 64:
        return columns
    return [(columns[0] >> U(bits * (n - 1 - i))) & mask(bits) for i in range(n)]


def head_bits(n: int, bits: int) -> int:
    return n * bits if n * bits <= 64 else bits


def leading(head: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The first `bits` bits of numbers of `width` bits."""
    return head >> U(width - bits) if bits else np.zeros(len(head), U)


def collapse(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted entries, equal ones added up."""
    if not len(count):
        return columns, count
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    columns, count = [c[order] for c in columns], count[order]
    new = np.ones(len(count), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(count, at)


class Filter:
    """Sorted entries of one shard: permuted n-grams (sort columns) and their counts."""

    def __init__(self, n: int, bits: int, split: int, columns: list[np.ndarray], count: np.ndarray):
        self.n, self.bits, self.split, self.columns, self.count = n, bits, min(split, head_bits(n, bits)), columns, count

    @classmethod
    def of(cls, ids: list[np.ndarray], bits: int, split: int = 0, count: np.ndarray | None = None) -> Filter:
        """A filter of n-grams in any order, with repeats; one that spans several shards is `parted` into them."""
        columns, count = collapse(packed(permute(ids, bits), bits), np.ones(len(ids[0]), np.int64) if count is None else count)
        return cls(len(ids), bits, split, columns, count)

    def ngrams(self) -> list[np.ndarray]:
        return restore(unpacked(self.columns, self.n, self.bits), self.bits)

    def merged(self, others: Iterable[Filter]) -> Filter:
        every = [self, *others]
        columns = [np.concatenate(c) for c in zip(*(f.columns for f in every), strict=True)]
        return Filter(self.n, self.bits, self.split, *collapse(columns, np.concatenate([f.count for f in every])))

    def at_least(self, least: int) -> Filter:
        kept = self.count >= least
        return Filter(self.n, self.bits, self.split, [c[kept] for c in self.columns], self.count[kept])

    def parted(self) -> Iterable[tuple[int, Filter]]:
        """The shards that the entries belong to, and each one's filter."""
        shard = leading(self.columns[0], head_bits(self.n, self.bits), self.split)
        edge = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *edge], [*edge, len(shard)], strict=True):
            if b > a:
                yield int(shard[a]), Filter(self.n, self.bits, self.split, [c[a:b] for c in self.columns], self.count[a:b])

    def sizes(self, entries: int) -> tuple[int, int]:
        """Bits of the quotient and of the first remainder, for so many entries."""
        width = head_bits(self.n, self.bits) - self.split
        q = min(width, max(0, entries.bit_length() - 1), 32)
        return q, width - q

    def dump(self) -> bytes:
        m = len(self.count)
        q, r = self.sizes(m)
        value = self.columns[0] & mask(q + r)
        runs = np.zeros(m + (1 << q), np.uint8)
        runs[leading(value, q + r, q).astype(np.int64) + np.arange(m)] = 1
        large = self.count[self.count >= LARGE].astype("<i8")
        rest = [(value & mask(r), r)] + [(c, self.bits) for c in self.columns[1:]]
        remainders = [x.astype("<u8").view(np.uint8).reshape(m, 8)[:, : -(-b // 8)].tobytes() for x, b in rest]
        small = np.minimum(self.count, LARGE).astype(np.uint8).tobytes()
        return b"".join([HEADER.pack(m, q, self.n, self.bits, self.split), np.packbits(runs).tobytes(), *remainders, small, large.tobytes()])

    @classmethod
    def load(cls, raw: bytes, shard: int) -> Filter:
        m, q, n, bits, split = HEADER.unpack_from(raw)
        found = cls(n, bits, split, [], np.zeros(0, np.int64))
        width, at = head_bits(n, bits) - split, HEADER.size
        r, size = width - q, -(-(m + (1 << q)) // 8)
        runs = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=m + (1 << q))
        at += size
        quotient = np.flatnonzero(runs) - np.arange(m)
        for b in [r] + [bits] * (0 if n * bits <= 64 else n - 1):
            wide, size = np.zeros((m, 8), np.uint8), -(-b // 8)
            wide[:, :size] = np.frombuffer(raw, np.uint8, m * size, at).reshape(m, size)
            at += m * size
            found.columns.append(wide.reshape(-1).view("<u8").astype(U))
        head = (quotient.astype(U) << U(r)) if r < 64 else np.zeros(m, U)
        found.columns[0] |= head | (U(shard) << U(width) if split else U(0))
        count = np.frombuffer(raw, np.uint8, m, at).astype(np.int64)
        count[count == LARGE] = np.frombuffer(raw, "<i8", -1, at + m)
        found.count = count
        return found

    def counts_of(self, ids: list[np.ndarray]) -> np.ndarray:
        """How often each of some n-grams was counted: its quotient's run is searched for the remainder."""
        wanted = packed(permute(ids, self.bits), self.bits)
        low = np.searchsorted(self.columns[0], wanted[0])
        high = np.searchsorted(self.columns[0], wanted[0], side="right")
        found = np.zeros(len(wanted[0]), np.int64)
        for step in range(int((high - low).max(initial=0))):
            at = np.minimum(low + step, max(0, len(self.count) - 1))
            same = low + step < high
            for mine, other in zip(self.columns, wanted, strict=True):
                same &= mine[at] == other
            found[same] = self.count[at[same]]
        return found
