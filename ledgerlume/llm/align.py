"""Alignment of two tokenizers over the same text.

Both tokenizers cut the bytes of a space and the text into tokens. The cumulative byte ends of either side
go into a dictionary from end to token index; the intersection of both key sets, sorted, are the places where
tokens of both sides end, and they slice both id lists into groups. The links are expanded per slice: of the
pairs of a slice those whose tokens end together, which is the last of either side as no token is empty.

Texts are cut where a space follows a visible sign. No token of either side goes across such a place
(`Side` holds the vocabularies to that, else texts stay whole), so a chunk has the same tokens wherever it
stands; a worker aligns a chunk once and keeps up to CACHED_CHUNKS of them. Whole texts are read at any length.

Two tokens that end together end with the same bytes, so one's bytes are a suffix of the other's. The pairs
that can ever be linked are therefore listed from the vocabularies alone (`Pairs`), whatever the corpus holds:
counts of links over the corpus are one number per possible pair, summed per task, then by Spark, and that
table of fixed size is what tasks get to weigh the links of their documents.

Defined results: null, empty and unfaithful texts (the joined bytes of a side differ from space + text) have
no tokens, no groups and no links; repeated rows give repeated results and count as often as they occur; an empty
table gives an empty result; ids may be null and of any type; columns other than doc_id and text pass by unseen.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import parts
from .prefixes import gather
from .storage import bounded_batches, materialise
from .workers import claim

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks whose alignment one worker holds.
CACHED_CHUNKS = 150_000
#: A space after a visible sign begins a chunk; other white space doesn't.
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
#: A token with a space after a visible sign.
CROSSING = re.compile(r"\S ")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Side:
    """One tokenizer: `encode` gives the ids of chunks, `tokens` the bytes of every id (None: never given)."""

    def __init__(self, encode, tokens: list[bytes | None]):
        self.encode, self.tokens = encode, tokens
        self.splits = not any(CROSSING.search(t.decode(errors="replace")) for t in tokens if t)
        self.size = np.array([len(t or b"") for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.start[ids], self.size[ids]).tobytes()


def byte_side(raw: bytes) -> Side:
    """A byte-level BPE from its JSON file; the merges must be in the order of their ids, as ranks decide."""
    model = json.loads(raw)["model"]
    letters, merges = byte_letters(), [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError("the merges aren't in the order of their ids")
    ranks = {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if all(c in letters for c in token) and (len(token) == 1 or n >= made[0])}
    known = {*made, *(model["vocab"][c] for c in letters if c in model["vocab"])}
    ranks = {token: n for token, n in ranks.items() if n in known}
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, n in ranks.items():
        tokens[n] = token
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda chunks: [encoding.encode_ordinary(c) for c in chunks], tokens)


def piece_side(raw: bytes) -> Side:
    """A piece BPE from its model file; it adds the space that every chunk begins with."""
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    alone = [model.piece_to_id("▁")]

    def encode(chunks: list[str]) -> list[list[int]]:
        found = model.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else alone for ids, c in zip(found, chunks, strict=True)]

    return Side(encode, tokens)


class Pairs:
    """All pairs (a, b) of which one's bytes are a suffix of the other's, in order: the pair's place is its code."""

    def __init__(self, a: Side, b: Side):
        def by_bytes(side):
            found: dict[bytes, list[int]] = {}
            for n, token in enumerate(side.tokens):
                if token:
                    found.setdefault(token, []).append(n)
            return found

        a_of, b_of, self.width = by_bytes(a), by_bytes(b), len(b.tokens)
        keys = {x * self.width + y for token, xs in a_of.items() for i in range(len(token)) for y in b_of.get(token[i:], ()) for x in xs}
        keys |= {x * self.width + y for token, ys in b_of.items() for i in range(len(token)) for x in a_of.get(token[i:], ()) for y in ys}
        self.keys = np.array(sorted(keys), np.int64)

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.width + b).astype(np.int32)

    @property
    def b(self) -> np.ndarray:
        return self.keys % self.width


def digits(most: int) -> np.ndarray:
    """Row n: the decimal digits of n as ASCII, right-aligned over zero bytes."""
    width = len(str(most))
    return np.frombuffer("".join(f"{n:>{width}}" for n in range(most + 1)).encode().replace(b" ", b"\0"), np.uint8).reshape(-1, width)


class Aligner:
    """Aligns texts of one task; remembers chunks."""

    def __init__(self, a: Side, b: Side, pairs: Pairs):
        self.a, self.b, self.pairs, self.splits = a, b, pairs, a.splits and b.splits
        self.digits = digits(max(len(a.tokens), len(b.tokens)))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # of every chunk: A tokens, B tokens, links, whether it is unfaithful
        self.links = np.zeros(0, np.int32)

    def faithful(self, new: list[str], ids: list[list[int]], side: Side) -> list[bool]:
        return [side.joined(np.array(x, np.int64)) == c.encode() for x, c in zip(ids, new, strict=True)]

    def learn(self, new: list[str]) -> None:
        """Align chunks that were numbered last."""
        found, counts, flat, ends = [self.a.encode(new), self.b.encode(new)], [], [], []
        raw = [len(c.encode()) for c in new]
        wrong = np.zeros(len(new), bool)
        whole = "".join(new).encode()
        for side, ids in zip((self.a, self.b), found, strict=True):
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            one = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
            stops = np.concatenate([[0], np.cumsum(side.size[one])])[np.cumsum(count)]
            if side.joined(one) != whole or stops.tolist() != np.cumsum(raw).tolist():
                wrong |= ~np.array(self.faithful(new, ids, side))
        for side, ids in zip((self.a, self.b), found, strict=True):
            ids = [() if w else x for x, w in zip(ids, wrong, strict=True)]
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64, int(counts[-1].sum())))
            ends.append(np.cumsum(side.size[flat[-1]]))
        # the cumulative ends of both sides, met in their dictionaries
        a_at, b_at = ({end: i for i, end in enumerate(e.tolist())} for e in ends)
        common = sorted(a_at.keys() & b_at.keys())
        a_last = np.fromiter(map(a_at.__getitem__, common), np.int64, len(common))
        b_last = np.fromiter(map(b_at.__getitem__, common), np.int64, len(common))
        stop = np.cumsum(np.where(wrong, 0, raw))
        per_chunk = np.diff(np.searchsorted(common, stop, side="right"), prepend=0)
        self.links = np.concatenate([self.links, self.pairs.codes(flat[0][a_last], flat[1][b_last])])
        self.sizes = np.concatenate([self.sizes, np.stack([*counts, per_chunk, wrong.astype(np.int64)], 1)])
        self.groups += self.written(flat, a_last, b_last, np.cumsum(per_chunk)[(per_chunk > 0)] - 1, wrong)

    def written(self, flat, a_last, b_last, closing, wrong) -> list[str]:
        """The groups of every chunk as text: `1,2|3;4|5`."""
        table = np.zeros((len(flat[0]) + len(flat[1]), self.digits.shape[1] + 1), np.uint8)
        slices = np.arange(len(a_last))
        for ids, last, shift in ((flat[0], a_last, np.concatenate([[0], b_last + 1])), (flat[1], b_last, a_last + 1)):
            group = np.repeat(slices, np.diff(last, prepend=-1))
            place = np.arange(len(ids)) + shift[group]
            table[place, :-1] = self.digits[ids]
            table[place, -1] = ord(",")
            table[place[last], -1] = ord("|") if last is a_last else ord(";")
            if last is b_last:
                table[place[last[closing]], -1] = ord("\n")
        lines = table[table > 0].tobytes().decode().split("\n")
        found = iter(lines[:-1])
        return ["" if w else next(found) for w in wrong]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """Of every text: tokens of A and of B and links (an array of three columns), groups as text, codes of its links."""
        if len(self.number) > CACHED_CHUNKS:
            self.forget()
        split = [() if not t else CHUNK.findall(" " + t) if self.splits else (" " + t,) for t in texts]
        number, new = self.number, []
        for c in chain.from_iterable(split):
            if c not in number:
                number[c] = len(number)
                new.append(c)
        if new:
            self.learn(new)
        at = [np.fromiter(map(number.__getitem__, s), np.int64, len(s)) for s in split]
        stop = np.cumsum([len(x) for x in at])
        chunks = np.concatenate([np.zeros(0, np.int64), *at])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sizes[chunks], 0)])
        sums = np.diff(sums[np.concatenate([[0], stop])], axis=0)
        wrong = sums[:, 3] > 0
        starts = np.cumsum(self.sizes[:, 2]) - self.sizes[:, 2]
        codes = [gather(self.links, starts[x], self.sizes[x, 2]) if not w else np.zeros(0, np.int32) for x, w in zip(at, wrong, strict=True)]
        groups = ["" if w else ";".join(map(self.groups.__getitem__, x.tolist())) for x, w in zip(at, wrong, strict=True)]
        return sums[:, :3] * ~wrong[:, None], groups, codes


def read(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def sides(a_raw: bytes, b_raw: bytes) -> tuple[Side, Side]:
    return byte_side(a_raw), piece_side(b_raw)


def possible_pairs(a_raw: bytes, b_raw: bytes) -> Pairs:
    """Some hundred thousand pairs for vocabularies of 50,000 and 32,000."""
    return Pairs(*sides(a_raw, b_raw))


def as_lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *values]))


def aligned(docs: DataFrame, a_raw: bytes, b_raw: bytes, pairs: Pairs) -> DataFrame:
    """doc_id, n_a, n_b, n_links, groups (text, A ids | B ids, groups parted by ;), links (codes of `pairs`) of every row.

    Both vocabularies and the pairs are broadcast: files of a fixed size.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((a_raw, b_raw, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (one, other, known) = claim("align"), shared.value
        key = hash(one), hash(other)
        if key not in held:
            held[key] = Aligner(*sides(one, other), known)
        for batch in batches:
            for part in parts(batch):
                counts, groups, codes = held[key].texts(part.column(1).to_pylist())
                columns = [part.column(0), *(pa.array(counts[:, i]) for i in range(3)), pa.array(groups, pa.string()), as_lists(codes)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_links", "groups", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_links long, groups string, links array<int>")


def pair_counts(rows: DataFrame, n_pairs: int) -> DataFrame:
    """pair (code) and n (long): how many links of the whole table hold it. Every task sends one row per pair it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_pairs, np.int64)
        for batch in batches:
            met = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            n += np.bincount(met, minlength=n_pairs) if len(met) else 0
        pair = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(n[pair])], names=["pair", "n"])

    return rows.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def weighed(rows: DataFrame, pairs: Pairs) -> DataFrame:
    """The columns of `rows`, which must be a written table, with n_best and count_sum for links."""
    n = np.zeros(len(pairs.keys), np.int64)
    known = pair_counts(rows, len(n)).toPandas()  # as many rows as there are possible pairs, at most
    n[known["pair"].to_numpy()] = known["n"].to_numpy()
    most = np.zeros(pairs.width, np.int64)
    np.maximum.at(most, pairs.b, n)
    shared = rows.sparkSession.sparkContext.broadcast((n, n == most[pairs.b]))
    kept = [c for c in rows.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in batches:
            links = batch.column(len(kept))
            met = links.flatten().to_numpy(zero_copy_only=False)
            stop = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[met].astype(np.int64))])[stop]) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "links").mapInArrow(run, f"{schema}, n_best long, count_sum long")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    docs, raw = spark.read.parquet(f"{sf_dir}/documents.parquet"), (read(A_FILE), read(B_FILE))
    pairs = possible_pairs(*raw)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = aligned(docs, *raw, pairs).select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", digest.alias("groups_sha256"), "links"
    )
    return weighed(materialise(rows, "alignments"), pairs)
