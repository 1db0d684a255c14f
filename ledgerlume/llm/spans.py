"""Words of many texts as byte spans with hashes, in a few numpy steps per part.

A word is a run of bytes that are neither separators nor breaks (both given as ASCII bytes). Texts are taken
together until a part has PART bytes; longer texts are cut at the first separator or break after that, so a
step's memory is bounded by a part and one word. Equal words have equal hashes everywhere; the hash is a
polynomial over random numbers of the bytes modulo 2**64, read off running sums, then mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

from .words import BASE, INVERSE, PART, U, mix, powers

LOWER = bytes(range(256)).replace(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Words(NamedTuple):
    """Words of one part in order."""

    blob: bytes
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    #: Which of the texts a word belongs to.
    text: np.ndarray
    #: Whether a word begins a text or has a break between it and the word before.
    broken: np.ndarray

    def spelled(self, i: int) -> bytes:
        return self.blob[self.start[i] : self.stop[i]]


class Splitter:
    """Splits texts into words; `seed` chooses among hashes."""

    def __init__(self, separators: bytes, breaks: bytes = b"", lower: bool = False, seed: int = 0):
        self.kind = np.zeros(256, np.uint8)
        self.kind[list(separators)] = 1
        self.kind[list(breaks)] = 2
        #: A sign to put between texts, and where long texts may be cut.
        self.joint = (breaks or separators)[:1]
        self.cut = re.compile(b"[" + re.escape(separators + breaks) + b"]")
        self.lower = lower
        self.value = mix(np.arange(1 + 256 * seed, 257 + 256 * seed, dtype=U) * U(BASE)) | U(1)

    def pieces(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > PART:
            gap = self.cut.search(text, at + PART)
            if not gap:
                break
            yield text[at : gap.start() + 1]
            at = gap.start() + 1
        yield text[at:]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[Words]:
        held, owner, fresh, size = [], [], [], 0
        self.pending = False
        for n, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            for i, piece in enumerate(self.pieces(raw.translate(LOWER) if self.lower else raw)):
                held.append(piece)
                owner.append(n)
                fresh.append(i == 0)
                size += len(piece)
                if size >= PART:
                    yield self.part(held, owner, fresh)
                    held, owner, fresh, size = [], [], [], 0
        if held:
            yield self.part(held, owner, fresh)

    def part(self, held: list[bytes], owner: list[int], fresh: list[bool]) -> Words:
        """The words of some pieces; only the first of them may continue a text (then `pending` tells of breaks since its last word)."""
        blob = self.joint.join(held)
        byte = np.frombuffer(blob, np.uint8)
        kind = self.kind[byte]
        edges = np.diff((kind == 0).view(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        total = np.zeros(len(byte) + 1, U)
        np.cumsum(self.value[byte] * powers(len(byte), BASE, "powers")[:-1], out=total[1:])
        hashes = mix((total[stop] - total[start]) * powers(len(byte), INVERSE, "inverses")[start] + (stop - start).astype(U))
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        piece = np.searchsorted(begin, start, side="right") - 1
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        broken = np.ones(len(start), bool)
        broken[1:] = (breaks[start[1:]] > breaks[stop[:-1]]) | (piece[1:] != piece[:-1])
        if not fresh[0]:
            if len(start) and piece[0] == 0:
                broken[0] = self.pending or breaks[start[0]] > 0
            elif len(held) == 1:  # no word yet
                self.pending = self.pending or bool(breaks[-1])
                return Words(blob, start, stop, hashes, np.array(owner, np.int64)[piece], broken)
        last = begin[-1]
        if len(start) and piece[-1] == len(held) - 1:
            last = stop[-1]
        else:  # the last text has no word yet, so its first one begins it
            self.pending = True
            return Words(blob, start, stop, hashes, np.array(owner, np.int64)[piece], broken)
        self.pending = bool(breaks[-1] > breaks[last])
        return Words(blob, start, stop, hashes, np.array(owner, np.int64)[piece], broken)
