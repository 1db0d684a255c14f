"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding: the token t
whose predecessor (the last token of the prefix before t) forms a valid pair with it, that is, no
merge across their border would have come first. `PrefixTable` stores that last token for each
prefix. Appending bytes only adds entries, encodings are read off backwards, and after an edit the
table is rebuilt only until it agrees with the old one over the longest token's length.

A text is split by the vocabulary's pattern and every match is a piece. A piece that is a token as a
whole is that token, as in the public encoder. The new pieces of a part go through the same programme
together (`prefixes`), pieces of over LONG bytes through a `PrefixTable` of their own. What a task
remembers of pieces is bounded.

Defined results: a null or empty text has no ids and decodes to the empty string; whole texts are
encoded at any length; repeated rows give repeated results; an empty table an empty one; columns
other than doc_id and text pass by unseen.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefixes import Pieces, Tables, gather
from .storage import bounded_batches
from .workers import claim

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids one worker holds, pairs that one `Vocabulary` holds, bytes of a piece that advances with others.
CACHED_PIECES, CACHED_PAIRS, LONG = 60_000, 50_000, 96
#: Rows and characters after which a part of a batch is closed.
ROWS_OUT, CHARS_OUT = 1024, 1 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Vocabulary:
    """Ranks, and how each token came about by merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Every beginning of a token, with the token's id or -1: a walk through it ends candidates early.
        self.begun = {token[:n]: -1 for token in ranks for n in range(1, len(token))} | ranks
        self._made: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}

    def made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens that `token` is merged from; itself twice for a byte, None if no merges reach it."""
        if token not in self._made:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            while len(parts) > 2:
                best = min(
                    (rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None
                ) if any(parts[i] + parts[i + 1] in self.ranks for i in range(len(parts) - 1)) else None
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1:
                self._made[token] = (token, token)
            else:
                self._made[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._made[token]

    def valid_pair(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens would leave exactly these two."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        """Take both tokens apart, the later merge first, and look for an earlier merge across the border."""
        if self.made_of(left) is None or self.made_of(right) is None:
            return False
        ranks, tokens, before = self.ranks, self.tokens, 1 << 62
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < before:
                return False
            if len(tokens[left]) == 1 and len(tokens[right]) == 1:
                return True
            if len(tokens[right]) == 1 or (len(tokens[left]) > 1 and left > right):
                before, left = left, self.made_of(left)[1]
            else:  # of merges with one rank the left one comes first
                before, right = right + 1, self.made_of(right)[0]


class PrefixTable:
    """The last token of the encoding of every prefix of a piece.

    `open` holds, for every prefix, where tokens may still be under way: the starts from which the
    bytes up to the prefix's end begin a token.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.open = vocabulary, b"", [], []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def truncate(self, size: int) -> None:
        self.data = self.data[:size]
        del self.last[size:], self.open[size:]

    def _fill(self, size: int) -> None:
        v, data, last = self.vocabulary, self.data, self.last
        begun, pairs = v.begun.get, v._pairs.get
        under_way = self.open[-1] if self.open else ()
        for end in range(len(last) + 1, size + 1):
            found, still = None, []
            for start in (*under_way, end - 1):
                token = begun(data[start:end])
                if token is None:
                    continue
                still.append(start)
                if found is None and token >= 0:
                    if start == 0:
                        if v.made_of(token) is not None:
                            found = token
                    else:
                        before = last[start - 1]
                        known = pairs(before << 32 | token)
                        if v.valid_pair(before, token) if known is None else known:
                            found = token
            last.append(found)
            self.open.append(still)
            under_way = still

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start..stop and return how many entries were computed again."""
        old_data, old_last, shift = self.data, self.last, len(new) - (stop - start)
        self.data = old_data[:start] + new + old_data[stop:]
        self.last, old_open, self.open = old_last[:start], self.open, self.open[:start]
        same, at = 0, start
        while at < len(self.data):
            self._fill(at + 1)
            at += 1
            behind = at - shift - 1
            beyond = at > start + len(new)
            same = same + 1 if beyond and self.last[-1] == old_last[behind] else 0
            if same >= self.vocabulary.longest:
                self.last += old_last[behind + 1 :]
                self.open += [[x + shift for x in o] for o in old_open[behind + 1 :]]
                break
        return at - start

    def tokens(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts of one task; holds the ids of the pieces it has met, up to CACHED_PIECES and a part's."""

    def __init__(self, vocabulary: Vocabulary | bytes, tables: Tables | None = None, pattern: str = public_tokenizers.PATTERN):
        self._vocabulary, self.split = vocabulary, regex.compile(pattern)
        self.pieces = Pieces(tables or Tables(self.vocabulary))
        self.forget()

    @property
    def vocabulary(self) -> Vocabulary:
        """Only long pieces need it in a task, so it is read from the rank file when the first one comes."""
        if isinstance(self._vocabulary, bytes):
            self._vocabulary = Vocabulary(read_ranks(self._vocabulary))
        return self._vocabulary

    def forget(self) -> None:
        self.number, self.count, self.ids = Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        """Append the ids of pieces that were numbered last."""
        raw = [piece.encode("utf-8", "surrogatepass") for piece in new]
        long = [i for i, piece in enumerate(raw) if len(piece) > LONG]
        flat, count = self.pieces.encode([b"" if len(piece) > LONG else piece for piece in raw])
        for i in reversed(long):
            ids = PrefixTable(self.vocabulary, raw[i]).tokens()
            at = int(count[:i].sum())
            flat = np.concatenate([flat[:at], np.array(ids, np.int32), flat[at:]])
            count[i] = len(ids)
        self.ids, self.count = np.concatenate([self.ids, flat]), np.concatenate([self.count, count])

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of every text; what the texts share is learned once."""
        if len(self.number) > CACHED_PIECES:
            self.forget()
        split = [self.split.findall(text) if text else [] for text in texts]
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        count = self.count[numbers]
        flat = gather(self.ids, (np.cumsum(self.count) - self.count)[numbers], count)
        pieces = np.cumsum([len(x) for x in split])
        return np.split(flat, np.concatenate([[0], np.cumsum(count)])[pieces])[:-1]


class Numbers(dict):
    """Piece to its number, by first appearance; `new` lists those that nobody has learned yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = found = len(self)
        self.new.append(piece)
        return found


class Decoder:
    """Ids to bytes by one gather over a table of all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.size[ids]
        stop = np.cumsum(size)
        place = np.arange(stop[-1], dtype=np.int64) + np.repeat(self.start[ids] - (stop - size), size)
        return self.bytes[place].tobytes()


def worker_encoder(raw: bytes, tables: Tables) -> Encoder:
    """One encoder per worker process and rank file."""
    held, key = claim("bpe"), ("encoder", hash(raw))
    if key not in held:
        held[key] = Encoder(raw, tables)
    return held[key]


def worker_decoder(raw: bytes) -> Decoder:
    held, key = claim("bpe"), ("decoder", hash(raw))
    if key not in held:
        held[key] = Decoder(read_ranks(raw))
    return held[key]


_tables: dict[bytes, Tables] = {}


def tables_of(raw: bytes) -> Tables:
    """The rank file's tables, made once on the driver: 30 MB for 50,000 tokens, whatever the corpus."""
    if raw not in _tables:
        _tables.clear()
        _tables[raw] = Tables(Vocabulary(read_ranks(raw)))
    return _tables[raw]


def rank_file(name: str = VOCABULARY) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, closed by rows or by the size of the second column (at least one row each)."""
    column = batch.column(1)
    size = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column), 0)
    stop = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        most = int(np.searchsorted(stop, (stop[at - 1] if at else 0) + CHARS_OUT, side="right"))
        end = min(max(at + 1, most), at + ROWS_OUT, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *ids]))


def encode(docs: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id and ids (array<int>) of every row; the rank file's bytes are broadcast, as their size is fixed."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, tables_of(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(*shared.value)
        for batch in batches:
            for part in parts(batch):
                ids = encoder.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), id_lists(ids)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, ids and decoded (the bytes) of rows with ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_decoder(shared.value)
        for batch in batches:
            for part in parts(batch):
                ids = part.column(1)
                values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                texts = [decoder.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, ids and decoded of every row, in one pass: ids are decoded where they were made."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, tables_of(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_encoder(*shared.value), worker_decoder(shared.value[0])
        for batch in batches:
            for part in parts(batch):
                ids = encoder.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), id_lists(ids), pa.array([decoder.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    done = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), rank_file())
    return digests(done)


def digests(done: DataFrame) -> DataFrame:
    """The digest columns of encoded and decoded rows."""
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
