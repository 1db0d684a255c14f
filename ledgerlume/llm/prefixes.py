"""Prefix tables of many pieces at once, in numpy.

The same dynamic programme as `bpe.PrefixTable`, but in lock-step: all pieces of a part advance by one
byte together. For every prefix the starts whose bytes up to its end begin a token are walked on in a trie;
a token that ends here is the prefix's last one if the pair with the last token of the prefix before it is
valid. All tables are arrays of a size fixed by the rank file, made once and broadcast.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
FACTOR = U(0x9E3779B97F4A7C15)
#: Pieces that advance together, and entries of the direct-mapped cache of pairs.
TOGETHER, PAIRS = 1 << 13, 1 << 18


class HashTable:
    """int64 keys to int32 values; -1 for keys that it doesn't hold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self.slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            taken, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[taken], self.values[taken] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * FACTOR) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        held, out = self.keys[slot], self.values[slot]
        wrong = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            out[wrong] = self.values[slot]
            on = (held != keys[wrong]) & (held != -1)
            wrong, slot = wrong[on], slot[on]
        return out


class Tables:
    """Trie, origins and joins of the tokens of a rank file."""

    def __init__(self, vocabulary):
        ranks = vocabulary.ranks
        most = max(ranks.values()) + 1
        self.size, self.left, self.right = np.zeros(most, np.int32), np.full(most, -1, np.int32), np.full(most, -1, np.int32)
        node_of, edges, children = {b"": 0}, [], []
        joins, joined = [], []
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            made = vocabulary.made_of(rank)
            if made:
                self.left[rank], self.right[rank] = made
            for n in range(1, len(token) + 1):
                begin = token[:n]
                if begin not in node_of:
                    node_of[begin] = len(node_of)
                    edges.append(node_of[token[: n - 1]] << 8 | token[n - 1])
                    children.append(node_of[begin])
                if n < len(token) and (a := ranks.get(begin)) is not None and (b := ranks.get(token[n:])) is not None:
                    joins.append(a << 32 | b)
                    joined.append(rank)
        self.children = HashTable(np.array(edges, np.int64), np.array(children, np.int32))
        self.joins = HashTable(np.array(joins, np.int64), np.array(joined, np.int32))
        #: The token that ends at a node, any of them and those that merges reach.
        self.token = np.full(len(node_of), -1, np.int32)
        for token, rank in ranks.items():
            self.token[node_of[token]] = rank
        self.made = np.where((self.token >= 0) & (self.left[self.token] >= 0), self.token, -1)
        #: The first byte's node, without a look-up.
        self.first = self.children.get(np.arange(256))

    def valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`Vocabulary.valid_pair` for arrays of tokens that merges reach."""
        out = np.zeros(len(left), bool)
        at, before = np.arange(len(left)), np.full(len(left), 1 << 62)
        left, right = left.astype(np.int64), right.astype(np.int64)
        while len(at):
            across = self.joins.get(left << 32 | right)
            on = (across < 0) | (across >= before)
            one_left, one_right = self.size[left] == 1, self.size[right] == 1
            out[at[on & one_left & one_right]] = True
            on &= ~(one_left & one_right)
            at, before, left, right, one_left, one_right = (x[on] for x in (at, before, left, right, one_left, one_right))
            back = one_right | (~one_left & (left > right))  # take the later merge apart; of one rank the left one comes first
            before = np.where(back, left, right + 1)
            left, right = np.where(back, self.right[left], left).astype(np.int64), np.where(back, right, self.left[right]).astype(np.int64)
        return out


class Pieces:
    """Encodes pieces; holds the cache of pairs."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.pair, self.known = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = ((key.astype(U) * FACTOR) >> U(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            found = self.tables.valid(keys >> 32, keys & 0xFFFFFFFF)
            out[new] = found[back]
            into = slot[new]
            self.pair[into], self.known[into] = key[new], out[new]
            # of several new keys of one slot the last stays, with its own answer
            clash = self.pair[into] != key[new]
            if clash.any():
                self.pair[into[clash]] = -1
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        counts, ids = np.zeros(len(pieces), np.int64), []
        for low in range(0, len(order), TOGETHER):
            some = order[low : low + TOGETHER]
            flat, n = self._together([pieces[i] for i in some])
            counts[some] = n
            ids.append(flat)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        of = np.concatenate([np.zeros(0, np.int64), np.array(order, np.int64)])
        start = np.zeros(len(pieces), np.int64)
        start[of] = np.cumsum(counts[of]) - counts[of]
        return gather(flat, start, counts), counts

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by falling length."""
        t = self.tables
        size = np.array([len(p) for p in pieces])
        most = int(size[0])
        raw = np.frombuffer(b"".join(p.ljust(most, b"\0") for p in pieces), np.uint8).reshape(len(pieces), most)
        raw = np.ascontiguousarray(raw.T)  # a row a byte position
        active = np.searchsorted(-size, -np.arange(most), side="left")  # pieces longer than a position
        last = np.zeros((most, len(pieces)), np.int32)
        whole = np.full(len(pieces), -1, np.int32)
        piece, start, node = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p in range(most):
            n = int(active[p])
            on = piece < n
            piece, start, node = piece[on], start[on], node[on]
            node = t.children.get(node << 8 | raw[p][piece])
            on = node >= 0
            piece = np.concatenate([piece[on], np.arange(n)])
            start = np.concatenate([start[on], np.full(n, p)])
            node = np.concatenate([node[on], t.first[raw[p][:n]]]).astype(np.int64)
            token = t.made[node]
            ends = np.flatnonzero(token >= 0)
            token, of, since = token[ends], piece[ends], start[ends]
            good = since == 0
            inner = np.flatnonzero(~good)
            good[inner] = self.valid(last[since[inner] - 1, of[inner]], token[inner])
            last[p, of[good]] = token[good]
            done = np.flatnonzero((start == 0) & (size[piece] == p + 1))
            whole[piece[done]] = t.token[node[done]]
        out, count, end = np.zeros((most, len(pieces)), np.int32), np.zeros(len(pieces), np.int64), size.copy()
        single = whole >= 0
        out[0, single], count[single], end[single] = whole[single], 1, 0
        while True:
            of = np.flatnonzero(end)
            if not len(of):
                break
            token = last[end[of] - 1, of]
            out[count[of], of] = token
            count[of] += 1
            end[of] -= t.size[token]
        back = np.arange(most)[:, None] < count[None, :]
        flat = out.T[back.T]  # tokens of each piece from its end to its beginning
        stop = np.cumsum(count)
        return flat[np.repeat(stop + stop - count - 1, count) - np.arange(len(flat))], count


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at `start` and are `count` long, one after the other."""
    stop = np.cumsum(count)
    return flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - count), count)]
