"""Folds, streams, files and the entry points."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from ledgerlume.operators import folds, learning, rules
from ledgerlume.sources import files
from ledgerlume.streaming import limits


def brute_limits(events, most, seconds):
    state, out = {}, {}
    for user, at, event in sorted(events):
        opened, used = state.get(user, (None, 0))
        if opened is None or at >= opened + seconds:
            opened, used = at, 0
        state[user] = (opened, used + 1)
        out[event] = used + 1 <= most
    return out


EVENTS = [(i % 3, 86_400 + 60 * (i * 7 % 50), i) for i in range(120)]


def events(spark):
    rows = spark.createDataFrame(EVENTS, "user_id long, at long, event_id long")
    return rows.select("user_id", "event_id", F.timestamp_seconds("at").alias("ts"))


def test_rate_limits_in_batch(spark):
    got = {r.event_id: r.allowed for r in folds.rate_limited(events(spark), 5, 900).collect()}
    assert got == brute_limits(EVENTS, 5, 900)


def test_rate_limits_in_a_stream(spark, tmp_path):
    events(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(f"{tmp_path}/in")
    run = limits.rate_limited_stream(stream, 5, 900).writeStream.format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination()
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == brute_limits(EVENTS, 5, 900)


def plain_learning(rows):
    """One correction of a field after the other, as (seq, extracted, corrected, eligible)."""
    validated, frozen, delta, out = [], False, 0, {}
    for seq, old, new, eligible in rows:
        values = {v for v in validated if v is not None}
        against = len(values) >= 2 or (len(values) == 1 and new not in values and sum(v in values for v in validated) >= 2)
        out[seq] = "REJEITADA" if frozen else "CONGELADA" if against else "VALIDADA" if eligible else "REJEITADA"
        frozen = frozen or out[seq] == "CONGELADA"
        if out[seq] == "VALIDADA":
            validated.append(new)
            move = 5 if old == new else -8 if len(validated) >= 3 else 0
            delta = max(-20, min(20, delta + move))
    return out, len(validated), delta, frozen


def test_learning_matches_one_correction_after_the_other(spark, monkeypatch):
    import random

    monkeypatch.setattr(learning, "STRETCH", 5)
    rng, rows = random.Random(6), []
    for field in range(60):
        usual = 0.97 if field % 2 else 0.8
        for i in range(rng.randrange(1, 40)):
            new = "a" if rng.random() < usual else rng.choice(["b", None, "c"])
            old = new if rng.random() < 0.5 else "z"
            rows.append((field, f"f{field}", len(rows), old, new, rng.random() < 0.8, None, "CONCORDANCIA_TOTAL" if rng.random() < 0.1 else None))
    frame = spark.createDataFrame(rows, "tenant long, field string, seq long, extracted string, corrected string, human boolean, note string, agreement string")
    judged = learning.judged(frame)
    got, known = {r.seq: r.status for r in judged.collect()}, {r.tenant: r for r in learning.knowledge(judged).collect()}
    for field in range(60):
        mine = [(r[2], r[3], r[4], not (r[7] and r[3] != r[4])) for r in rows if r[0] == field]
        out, validated, delta, frozen = plain_learning(mine)
        assert {s: got[s] for s in out} == out
        assert (known[field].validated, known[field].delta, known[field].frozen) == (validated, delta, frozen)


def test_json_lines_and_upsert(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, seq long")
    files.append_json_lines(rows, f"{tmp_path}/log")
    files.append_json_lines(rows.limit(1), f"{tmp_path}/log")
    back = files.read_json_lines(spark, f"{tmp_path}/log", "id long, v string, seq long")
    assert back.count() == 3
    newer = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], rows.schema)
    assert sorted((r.id, r.v) for r in files.upsert(rows, newer, "id", "seq").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert "<td>a</td>" in files.html_report(rows.orderBy("id"), "T", 1)


def test_glyphs(spark):
    rows = [(1, 1, 0, "No", 0.0, 0.0, 10.0, 10.0), (1, 1, 1, "ta", 10.1, 0.0, 10.0, 10.0), (1, 1, 2, "x", 30.0, 0.0, 5.0, 10.0), (1, 1, 3, "y", 0.0, 20.0, 5.0, 10.0)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, seq int, str string, x double, y double, width double, font double")
    assert files.glyph_text(frame).first().text == "Nota x\ny"


def test_risk_cascade(spark):
    rows = [(40.0, True, "OCR", False), (65.0, True, "OCR", True), (80.0, True, "OCR", True), (40.0, False, "OCR", False), (65.0, True, "OCR", False), (65.0, False, "OCR", False), (90.0, True, "INFERENCIA", False), (90.0, True, "OCR", False)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c double, k boolean, o string, f boolean")
    got = [r.v for r in frame.select("i", rules.risk(F.col("c"), F.col("k"), F.col("o"), F.col("f")).alias("v")).orderBy("i").collect()]
    assert got == ["CRITICO", "CRITICO", "ALTO", "ALTO", "ALTO", "MEDIO", "MEDIO", "BAIXO"]


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
