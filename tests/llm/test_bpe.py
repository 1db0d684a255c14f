import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgerlume.llm import bpe as B


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(B.read_ranks(B.rank_file()))


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_random_texts_match_the_public_encoder(vocabulary, reference):
    rng, encoder = random.Random(1), B.Encoder(vocabulary)
    alphabets = ["ab", "the aeinorst", "aA'sdé ß日本\n\t ", "0123456789 .,-", "=-_*# ", "".join(map(chr, range(0x20, 0x3000, 7)))]
    texts = ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randrange(80))) for i in range(6000)]
    texts += ["a" * 3000, " " * 1000, "aé" * 500, "<|endoftext|>", "it's I'LL we'll  x", None, ""]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text or ""), text


def test_small_caches_give_the_same_ids(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(B, "CACHED_PIECES", 5)
    encoder, texts = B.Encoder(vocabulary), ["one two three four five six seven", "one eight nine ten", "two one eight"] * 3
    assert [encoder.encode_all([t])[0].tolist() for t in texts] == [reference.encode_ordinary(t) for t in texts]


def test_pieces_together_agree_with_prefix_tables(vocabulary, monkeypatch):
    from ledgerlume.llm import prefixes

    monkeypatch.setattr(prefixes, "TOGETHER", 64)
    monkeypatch.setattr(prefixes, "PAIRS", 16)
    rng, some = random.Random(4), prefixes.Pieces(prefixes.Tables(vocabulary))
    pieces = [bytes(rng.choices([b"ab", b"thequick ", bytes(range(256))][i % 3], k=rng.randrange(1, 40))) for i in range(900)]
    ids, count = some.encode(pieces)
    assert [list(x) for x in B.np.split(ids, count.cumsum()[:-1])] == [B.PrefixTable(vocabulary, p).tokens() for p in pieces]
    assert some.encode([])[0].size == 0 and some.encode([b"", b"a"])[1].tolist() == [0, 1]


def test_appends_and_edits_agree_with_a_fresh_table(vocabulary):
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choices(b"abcdehinorst ", k=rng.randrange(1, 600)))
        table = B.PrefixTable(vocabulary, data[:5])
        table.append(data[5:])
        assert (table.last, table.open) == (B.PrefixTable(vocabulary, data).last, B.PrefixTable(vocabulary, data).open)
        a = rng.randrange(len(data))
        b, new = min(len(data), a + rng.randrange(4)), bytes(rng.choices(b"abest ", k=rng.randrange(4)))
        table.replace(a, b, new)
        fresh = B.PrefixTable(vocabulary, data[:a] + new + data[b:])
        assert (table.data, table.last, table.open, table.tokens()) == (fresh.data, fresh.last, fresh.open, fresh.tokens())


def test_edits_near_the_start_stop_early(vocabulary):
    table = B.PrefixTable(vocabulary, b"the quick brown fox jumps " * 400)
    assert table.replace(10, 11, b"Q") < 1000


def test_round_trip_in_spark(spark, reference):
    long = "naïve 日本 words 123 " * 20_000
    rows = [(1, "it's a test", 1), (2, None, 1), (3, "", 1), (4, long, 1), (1, "it's a test", 1), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    done = B.round_trip(docs, B.rank_file())
    got = sorted((r.doc_id or -1, list(r.ids), bytes(r.decoded).decode()) for r in done.collect())
    assert got == sorted((i or -1, reference.encode_ordinary(t or ""), t or "") for i, t, _ in rows)
    apart = B.decode(B.encode(docs, B.rank_file()), B.rank_file())
    assert sorted((r.doc_id or -1, list(r.ids), bytes(r.decoded).decode()) for r in apart.collect()) == got
    assert B.round_trip(docs.limit(0), B.rank_file()).count() == 0


def test_query_on_the_small_tables(spark, reference):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in B.op1_byte_bpe(spark, d).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
