import random

from ledgerlume.llm import license_scan as S


def brute(text):
    """Best share of each template over all windows of its length, without bands or marker words."""
    words, out = S.python_words(text or ""), {}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    if not words:
        return out
    found = {}
    for name, _, t in S.template_pieces(S.TEMPLATES):
        want = shingles(t)
        best = max((len(shingles(words[a : a + len(t)]) & want) / len(want), -a) for a in range(max(1, len(words) - len(t) + 1)))
        found.setdefault(name, []).append(best)
    for name, bests in found.items():
        good = [b for b in bests if b[0] >= S.THRESHOLD]
        if len(good) >= S.THRESHOLD * len(bests):
            out[name] = (min(-b[1] for b in good), round(sum(b[0] for b in good) / len(bests), 9))
    return out


def test_matches_brute_force(spark):
    rng, words = random.Random(4), ["the", "of", "license", "software", "licensed", "under", "copy", "x", "y", "version"]
    texts = {}
    for i in range(60):
        body = rng.choices(words, k=rng.randrange(3, 60))
        for name in rng.sample(sorted(S.TEMPLATES), 2):
            t = S.TEMPLATES[name].split()
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            at = rng.randrange(len(body))
            body[at:at] = t
        texts[i] = "\n".join(" ".join(body[j : j + 9]) for j in range(0, len(body), 9)).swapcase()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, template string")
    got = {}
    for r in S.scan(docs).collect():
        got.setdefault(r.doc_id, {})[r.template] = (r.at, r.containment)
    assert got == {i: b for i, t in texts.items() if (b := brute(t))}


def test_markers_cover_every_shingle():
    pieces = S.template_pieces(S.TEMPLATES)
    markers = set(S.marker_words(pieces))
    assert all(markers & set(w[i : i + 5]) for _, _, w in pieces for i in range(max(1, len(w) - 4)))


def test_nulls_empty_long_repeats(spark):
    notice = S.TEMPLATES["mit-notice"]
    rows = [(1, None), (2, ""), (3, "word " * 50_000 + notice), (3, "word " * 50_000 + notice), (None, notice), (4, "license " * 3000), (5, "MIT")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, at int")
    got = sorted((r.doc_id or -1, r.template, r.at, r.containment) for r in S.scan(docs).collect())
    assert got == [(-1, "mit-notice", 0, 1.0), (3, "mit-notice", 50_000, 1.0)]
    assert S.scan(docs.limit(0)).count() == 0


def test_query_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    want = {(r.doc_id, n) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for n in brute(r.text)}
    assert {(r.doc_id, r.template) for r in S.op5_license_scan(spark, d).collect()} == want and want


def test_main_path_is_native(spark):
    plan = S.op5_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
