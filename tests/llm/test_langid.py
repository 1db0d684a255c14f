import zlib
from collections import Counter, defaultdict
from math import exp, log

from ledgerlume.llm import langid as L

SMALL = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_split(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = L.op6_language_id(spark, SMALL).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_scores_match_a_plain_calculation(spark):
    rows = [(1, "aba abc", "x"), (2, "xyz zyx", "y"), (3, "ab xy", None), (4, "abba", "x")]
    model = L.Model.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        if lang:
            counts[lang].update(L.grams(text)[0].tolist())
    total = {k: sum(v.values()) + L.SMOOTHING * L.BUCKETS for k, v in counts.items()}
    ids = L.grams("abz")[0].tolist()
    sums = {k: sum(log((counts[k][i] + L.SMOOTHING) / total[k]) for i in ids) for k in counts}
    (lang, _, other), (score, _, third) = model.score(["abz", None, "xyz " * 40_000])
    assert other == "y" and third > 0.99
    best = max(sums, key=sums.get)
    assert lang == best and abs(score - 1 / sum(exp(v - sums[best]) for v in sums.values())) < 1e-4


def test_folding():
    assert L.grams("Ab, CD!")[0].tolist() == L.grams("ab cd")[0].tolist() and not L.grams("12 !?")[1]
    assert len(L.grams("ab")[0]) == 4 + 3 + 2


def test_nulls_no_letters_ties_long_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "b", 0), (2, "", "b", 0), (3, "123 !", "b", 0), (4, "same", "b", 0), (5, "same", "a", 0), (6, "w " * 300_000, None, 0), (None, "same", None, 0)], "doc_id long, text string, lang string, score int")
    model = L.Model.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4] == got[5] == got[None] == ("a", 0.5) and got[6][0] in "ab"
    empty = L.Model.fit(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, empty).collect()} == {"und"} and L.predict(docs.limit(0), model).count() == 0
