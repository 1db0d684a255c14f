import numpy as np

from ledgerlume.llm import toxicity as X

SMALL = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = X.Model.fit(docs, labels.filter("doc_id % 4 > 0"))
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    out = [(r.toxic, got[r.doc_id].toxic) for r in labels.filter("doc_id % 4 = 0").collect()]
    assert np.mean([p for t, p in out if t == 1]) > 0.88 and np.mean([p for t, p in out if t == 0]) < 0.01
    assert len(got) == docs.count() and all(0 <= r.severity <= 2 for r in got.values())


def test_fit_matches_numeric_slopes():
    """At the optimum the likelihood falls off in every direction."""
    rng = np.random.default_rng(0)
    n, m = 3000, 3
    x, true = rng.random((n, m)), np.array([4.0, -3.0, 2.0])
    grade = (x @ true + rng.logistic(size=n)[:] > 1.0).astype(int) + (x @ true + rng.logistic(size=n) > 3.0)
    doc, column = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    fit = X.Ordinal.fit(doc, column, x.ravel(), grade, m)

    def loss(w, t):
        above = np.concatenate([np.ones((n, 1)), X.sigmoid((x @ w)[:, None] - t), np.zeros((n, 1))], axis=1)
        share = np.where(grade > 0, max(1.0, (grade == 0).sum() / (grade > 0).sum() / 2), 1.0) / n
        return -(share * np.log(above[np.arange(n), grade] - above[np.arange(n), grade + 1])).sum()

    assert fit.thresholds[0] < fit.thresholds[1]
    at = loss(fit.weights, fit.thresholds)
    for i in range(m):
        for d in (-0.5, 0.5):
            assert loss(fit.weights + d * np.eye(m)[i], fit.thresholds) > at
    assert at < loss(np.zeros(m), fit.thresholds)


def test_severity_grows_with_the_share_of_toxic_words(spark):
    docs = [(i, "good fine words here " * 5 + "vile " * (i % 10 if i % 2 else 0), 0) for i in range(400)]
    docs += [(1000, "vile", 0), (1001, None, 0), (1002, "", 0), (1003, "good " * 100_000, 0), (1003, "good " * 100_000, 0), (None, "vile vile", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(400)] + [(None, 1, 1), (3, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = X.score(frame, X.Model.fit(frame, labels)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(docs) and by_id[1].severity < by_id[3].severity <= by_id[9].severity and by_id[9].toxic
    assert not by_id[1001].toxic and by_id[1001].severity == by_id[1002].severity == by_id[1003].severity
    assert by_id[None].toxic and X.score(frame.limit(0), X.Model.fit(frame, labels)).count() == 0


def plain_features(word):
    import xxhash

    forms = [b"w" + word.encode()] + [b"p" + word[:n].encode() for n in (3, 4, 5, 6) if len(word) >= n]
    return [xxhash.xxh3_64_intdigest(f) % X.BUCKETS for f in forms]


def small_world():
    import random

    rng, words = random.Random(9), [f"wort{i}" for i in range(60)] + ["vile", "viler", "foul"]
    texts, labels = {}, {}
    for i in range(300):
        body = rng.choices(words[:60], k=rng.randrange(3, 260))
        labels[i] = int(rng.random() < 0.3)
        if labels[i]:
            at = rng.randrange(len(body))
            body[at:at] = rng.choices(words[60:], k=rng.randrange(2, 9))
        texts[i] = " ".join(body)
    return texts, labels


def test_statistics_of_the_features_match_a_plain_calculation(spark):
    texts, labels = small_world()
    train = spark.createDataFrame([(texts[i], labels[i]) for i in texts], "text string, label int")
    got = {r.feature: r.z for r in X.telling_features(train).collect()}
    held = {0: {}, 1: {}}
    for i, text in texts.items():
        for f in {f for w in set(text.split()) for f in plain_features(w)}:
            held[labels[i]][f] = held[labels[i]].get(f, 0) + 1
    clean, toxic = sum(v == 0 for v in labels.values()), sum(labels.values())
    want = {}
    for f in set(held[0]) | set(held[1]):
        a, b = held[0].get(f, 0), held[1].get(f, 0)
        share = (a + b) / (clean + toxic)
        z = (b / toxic - a / clean) / max(share * (1 - share), 1e-9) ** 0.5 / (1 / clean + 1 / toxic) ** 0.5
        if a + b >= X.LEAST_DOCS and z >= X.LEAST_Z:
            want[f] = z
    assert set(got) == set(want) and want and all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_query_matches_a_plain_calculation(spark, tmp_path):
    """The model as fitted, every window of every text by loops."""
    texts, labels = small_world()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    model = X.Model.fit(docs, known)
    got = {r.doc_id: r for r in X.op7_toxicity(spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        words = text.split()
        starts = sorted({min(s, max(0, len(words) - X.WINDOW)) for s in range(0, max(1, len(words) - X.WINDOW + X.STRIDE), X.STRIDE)})
        best = -np.inf
        for s in starts:
            seen = [model.column_of[f] for w in words[s : s + X.WINDOW] for f in plain_features(w) if f in model.column_of]
            scale = X.SCALE / min(X.WINDOW, len(words))
            best = max(best, sum(min(1.0, seen.count(c) * scale) * model.ordinal.weights[c] for c in set(seen)))
        p = 1 / (1 + np.exp(model.ordinal.thresholds - best))
        assert abs(got[i].severity - p.sum()) < 1e-6 and got[i].toxic == (p[0] >= 0.5)
    assert np.mean([got[i].toxic == bool(labels[i]) for i in texts]) > 0.95


def test_one_kind_of_label_only(spark):
    frame = spark.createDataFrame([(1, "a b c d", 0)], "doc_id long, text string, toxic int")
    for rows in ([], [(1, 1, 0)]):
        model = X.Model.fit(frame, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert [(r.severity, r.toxic) for r in X.score(frame, model).collect()] == [(0.0, False)]


def test_toxic_passages_in_long_texts(spark):
    """A passage counts wherever it stands and however long the text around it is."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = X.Model.fit(docs, labels.filter("doc_id % 4 > 0"))
    known = docs.join(labels, "doc_id").filter("doc_id % 4 > 0").select("text", "toxic").collect()
    held = [{}, {}]
    for r in known:
        for w in set(X.WORD.findall((r.text or "").lower())):
            held[r.toxic][w] = held[r.toxic].get(w, 0) + 1
    telling = sorted((w for w in held[1] if w not in held[0]), key=lambda w: (-held[1][w], w))[:10]
    alone = docs.join(labels, "doc_id").filter("toxic = 0 AND doc_id % 4 = 0")
    alone = alone.join(X.score(alone, model).filter("NOT toxic").select("doc_id"), "doc_id").select("doc_id", "text").orderBy("doc_id")
    clean = [w for r in alone.collect() for w in (r.text or "").split()]  # texts that are clean one by one stay clean when joined
    rng, rows = np.random.default_rng(0), []
    for size in (1000, 10_000, 20_000):
        for i in range(40):
            at = int(rng.integers(0, len(clean) - size))
            words, where = clean[at : at + size], int(rng.integers(0, size))
            rows.append((len(rows), " ".join(words), size, False))
            rows.append((len(rows), " ".join(words[:where] + list(rng.choice(telling, 6, replace=False)) + words[where:]), size, True))
    frame = spark.createDataFrame(rows, "doc_id long, text string, size int, planted boolean")
    got = {r.doc_id: r.toxic for r in X.score(frame, model).collect()}
    for size in (1000, 10_000, 20_000):
        assert np.mean([got[i] for i, _, n, planted in rows if n == size and planted]) > 0.95
        assert np.mean([got[i] for i, _, n, planted in rows if n == size and not planted]) < 0.1


def test_windows_cover_every_word():
    columns = X.Columns({X.word_features("vile")[0]: 0})
    for size in (1, X.STRIDE, X.WINDOW, X.WINDOW + 1, X.WINDOW + X.STRIDE, 1234):
        for at in {0, size // 2, size - 1}:
            text = " ".join("vile" if i == at else "fine" for i in range(size))
            many, window, column, value = X.windows(text, columns)
            assert many == 1 + max(0, -(-(size - X.WINDOW) // X.STRIDE)) and len(window) >= 1 and set(column) == {0}
            assert set(value) == {min(1.0, X.SCALE / min(size, X.WINDOW))}
