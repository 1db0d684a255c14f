import hashlib
import random
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlume.llm import align as L


@pytest.fixture(scope="module")
def raw():
    return L.read(L.A_FILE), L.read(L.B_FILE)


@pytest.fixture(scope="module")
def pairs(raw):
    return L.possible_pairs(*raw)


@pytest.fixture(scope="module")
def plainly(raw):
    """Groups of ids of a text by the public libraries and a walk over both sides' ends; None: no tokens."""
    a = Tokenizer.from_file(public_tokenizers.path(L.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(L.B_FILE))
    letters = L.byte_letters()

    def groups(text):
        if not text:
            return []
        found = []
        for ids, token in (
            (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
            (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
        ):
            tokens = [token(i) for i in ids]
            if b"".join(tokens) != (" " + text).encode():
                return []
            found.append((ids, list(accumulate(map(len, tokens)))))
        (a_ids, a_ends), (b_ids, b_ends) = found
        out, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            n, m = bisect_right(a_ends, end), bisect_right(b_ends, end)
            out.append((a_ids[i:n], b_ids[j:m]))
            i, j = n, m
        return out

    return groups


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


TEXTS = [None, "", " ", "a", "hello world", "  two  spaces ", "line\n  and\n\nline\t\tx \r\n y", "<|endoftext|> and </s> <s> <0x41>", "日本語のテキスト é́ ﬁ", "x\0y \x1c z\xa0 w  v", "▁ under ▁▁ lines", "a" * 700, " \n \n ", "🙂🙂 🙂", "it's I'LL 12345 ...", "� ﻿ a"]


def random_texts(n):
    rng = random.Random(5)
    alphabets = ["ab ", "the quick\n ", "aé ß日 \t\n", " \n\t\xa0\x1cx", "0123456789 .,-", "".join(map(chr, range(0x20, 0x3000, 11))) + "     "]
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randrange(1, 60))) for i in range(n)]


def test_groups_are_those_of_the_public_libraries(raw, pairs, plainly):
    texts = TEXTS + random_texts(1500)
    aligner = L.Aligner(*L.sides(*raw), pairs)
    counts, groups, codes = aligner.texts(texts)
    for text, n, g, c in zip(texts, counts.tolist(), groups, codes, strict=True):
        expected = plainly(text)
        assert g == written(expected), text
        assert n == [sum(len(x) for x, _ in expected), sum(len(y) for _, y in expected), len(expected)], text
        assert [(k // pairs.width, k % pairs.width) for k in pairs.keys[c].tolist()] == [(x[-1], y[-1]) for x, y in expected], text


def test_small_caches_and_whole_texts_give_the_same(raw, pairs, monkeypatch):
    texts = TEXTS + random_texts(200)
    expected = L.Aligner(*L.sides(*raw), pairs).texts(texts)
    monkeypatch.setattr(L, "CACHED_CHUNKS", 3)
    small, whole = L.Aligner(*L.sides(*raw), pairs), L.Aligner(*L.sides(*raw), pairs)
    whole.splits = False
    assert [small.texts([t])[1][0] for t in texts] == expected[1] == whole.texts(texts)[1]


def test_unfaithful_chunks_leave_their_texts_without_tokens(raw, pairs):
    a, b = L.sides(*raw)
    honest = b.encode
    b.encode = lambda chunks: [ids[:-1] if " lost" in c else ids for c, ids in zip(chunks, honest(chunks), strict=True)]
    counts, groups, codes = L.Aligner(a, b, pairs).texts(["all is well", "all is lost here", "well"])
    assert counts[1].tolist() == [0, 0, 0] and groups[1] == "" and not len(codes[1])
    assert groups[0] and groups[2] and counts[0][0] == 3


def by_hand(rows, plainly):
    found = [(i, plainly(text)) for i, text in rows]
    links = Counter((x[-1], y[-1]) for _, groups in found for x, y in groups)
    most = Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    out = []
    for i, groups in found:
        n = [(links[x[-1], y[-1]], most[y[-1]]) for x, y in groups]
        digest = hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(groups), sum(x == y for x, y in n), sum(x for x, _ in n), digest))
    return sorted(out, key=repr)


def test_query_is_the_brute_force(spark, plainly):
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    found = L.op11_tokenizer_alignment(spark, at).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(rows, plainly)


def test_nulls_repeats_clashing_columns_other_ids_and_empty_tables(spark, plainly, tmp_path):
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(None, "hello world"), (3, "a"), (3, "a b"), (9, "a " * 30_000)]
    for kind, cast in (("long", int), ("string", str)):
        rows_of_kind = [(None if i is None else cast(i), t) for i, t in rows]
        docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows_of_kind], f"doc_id {kind}, text string, links int, groups string, n_a int")
        docs.write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        found = L.op11_tokenizer_alignment(spark, f"{tmp_path}/{kind}").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(tuple, found), key=repr) == by_hand(rows_of_kind, plainly)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert L.op11_tokenizer_alignment(spark, f"{tmp_path}/none").count() == 0
