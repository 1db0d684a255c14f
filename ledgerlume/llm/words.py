"""Hashes of the words of many texts, in a few numpy steps per part and without a dictionary.

A word's hash is a polynomial over its code points modulo 2**64, read off running sums, then mixed. Words
are what `str.split` finds in lower-case text; `symbols` takes runs of word characters and runs of other
visible signs instead, in the text's own case. Long texts are cut at white space into parts, so the memory
of a step is bounded by PART code points and one word. Equal words have equal hashes everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

U = np.uint64
#: Code points that one step works on.
PART = 1 << 17
#: Odd constants of the hash: spread of code points, base of the polynomial, its inverse modulo 2**64.
SPREAD, BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
WHITE = re.compile(r"\s")

_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def kinds() -> np.ndarray:
    """Kind of every code point: 0 white space, 1 word character, 2 anything else."""
    if "kinds" not in _tables:
        table = np.full(0x110000, 2, np.uint8)
        signs = "".join(map(chr, range(0x110000)))
        for pattern, kind in ((r"\w+", 1), (r"\s+", 0)):
            for m in re.finditer(pattern, signs):
                table[m.start() : m.end()] = kind
        _tables["kinds"] = table
    return _tables["kinds"]


def powers(n: int, base: int, name: str) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the common length is kept."""
    held = _tables.get(name)
    if held is None or len(held) <= n:
        held = np.full(max(n, PART + 4096) + 1, base, U)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 4 * PART:
            _tables[name] = held
    return held[: n + 1]


def pieces(text: str) -> list[str]:
    """The text cut at white space into pieces of about PART characters."""
    if len(text) <= PART:
        return [text]
    out, at = [], 0
    while at < len(text):
        gap = WHITE.search(text, at + PART)
        end = gap.start() if gap else len(text)
        out.append(text[at:end])
        at = end
    return out


def hash_part(parts: list[str], symbols: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of `parts`, and how many each has."""
    size = np.array([len(p) for p in parts])
    cp = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, U), np.zeros(len(parts), np.int64)
    kind = kinds()[cp]
    if not symbols:
        kind = (kind > 0).view(np.uint8)
    bounds = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(cp)]])
    seen = np.flatnonzero(kind[bounds[:-1]])
    start, stop = bounds[seen], bounds[seen + 1]
    value = (cp.astype(U) + U(1)) * U(SPREAD)
    value ^= value >> U(29)
    value *= powers(len(cp), BASE, "powers")[:-1]
    total = np.zeros(len(cp) + 1, U)
    np.cumsum(value, out=total[1:])
    raw = (total[stop] - total[start]) * powers(len(cp), INVERSE, "inverses")[start]
    begin = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    return mix(raw + (stop - start).astype(U)), np.diff(np.searchsorted(start, np.append(begin, len(cp) + 1)))


def word_hashes(texts: Iterable[str | None], symbols: bool = False) -> list[np.ndarray]:
    """64-bit hashes of each text's words in order; none for a null or empty text."""
    found: list[list[np.ndarray]] = []
    parts, owner, size = [], [], 0

    def close() -> None:
        hashes, counts = hash_part(parts, symbols)
        for n, piece in zip(owner, np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
            found[n].append(piece)
        parts.clear()
        owner.clear()

    for n, text in enumerate(texts):
        found.append([])
        for piece in pieces(text) if text else ():
            parts.append(piece if symbols else piece.lower())
            owner.append(n)
            size += len(piece)
            if size >= PART:
                close()
                size = 0
    if parts:
        close()
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, U) for p in found]
