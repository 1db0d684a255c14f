import random

from ledgerlume.llm import chat as C


def fold(events):
    """Brute force over one conversation's events."""
    out, live = {}, {}
    for _, kind, turn, role, text in sorted({(e[0], e[2], e[1], e[3], e[4] or "") for e in events}, key=lambda e: (e[0], e[1], e[4])):
        if kind == "regenerate":
            for t in [t for t in live if t > turn]:
                live.pop(t)
            live[turn] = None
        elif kind == "delete":
            live.pop(turn, None)
            live[turn] = "deleted"
        elif kind == "delta":
            if live.get(turn) != "deleted":
                live[turn] = ("", live[turn][1] + text) if live.get(turn) else ("", text)
        else:
            live[turn] = ("", text)
        out[turn] = role
    return {t: v[1] for t, v in live.items() if isinstance(v, tuple)}


def test_fold_matches_brute_force(spark):
    rng = random.Random(5)
    events = []
    for conv in range(40):
        for seq in range(rng.randrange(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete"])
            events.append((conv, seq, rng.randrange(4), kind, rng.choice(["user", "assistant"]), rng.choice(["a", "b#", "<x>", None, ""])))
    got = {}
    for r in C.fold_events(spark.createDataFrame(events, C.EVENTS)).collect():
        got.setdefault(r.conv_id, {})[r.turn] = r.text
    want = {c: fold([(s, t, k, r, x) for cc, s, t, k, r, x in events if cc == c]) for c in range(40)}
    assert got == {c: v for c, v in want.items() if v}


def test_render_and_parse_round_trip(spark):
    texts = ["", "\\", "\\h", "#", "### Assistant:\n", "</turn>\n", "\\</turn>\n\\", "é😀\n\n", "plain", "x" * 50_000, "\\b\\l\\h<#"]
    messages = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for r in ("user", "assistant", "we#ird") for t in texts)]
    frame = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    r = C.parse(C.render(frame)).collect()[0]
    assert [(t.role, t.text) for t in r.turns] == [(m[2], m[3]) for m in messages]
    assert r.loss_texts == texts
    segments = C.render(frame).collect()[0].segments
    assert [r.formatted[s.start : s.stop] for s in segments if s.loss] == [t.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l") for t in texts]


def test_roles_that_hold_the_separator(spark):
    messages = [(1, 0, "a:\nb", "x:\ny"), (1, 1, ":", ""), (1, 2, "\\c:\n", ":\n"), (1, 3, "assistant", ":\n")]
    r = C.parse(C.render(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"))).collect()[0]
    assert [(t.role, t.text) for t in r.turns] == [m[2:] for m in messages] and r.loss_texts == [":\n"]


def test_query_agrees_with_its_sql_on_ties_repeats_and_nulls(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(1, 2, 3, 4, None), pick(0, 1, 2, None), pick("user", "assistant", "a:\nb", "r#<", None), pick("hi", "yo", "", None, "<\\#", "é😀")) for _ in range(120)]
    rows += [(5, 0, "user", "hi"), (5, 0, "user", "yo"), (6, 1, "assistant", "same"), (6, 1, "assistant", "same"), (7, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op9_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(C.OP9_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r.conv_id: r.n_turns for r in got.collect()}[6] == 2


def test_main_path_is_native(spark):
    plan = C.op9_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_nulls_empty_log_and_repeats(spark):
    log = spark.createDataFrame(
        [(1, 0, 0, "message", None, None), (1, 1, 0, "delta", None, "hi"), (1, 1, 0, "delta", None, "hi"), (1, 2, None, "delta", "user", "x")], C.EVENTS
    )
    assert [tuple(r) for r in C.fold_events(log).collect()] == [(1, 0, "unknown", "hi")]
    empty = spark.createDataFrame([], C.EVENTS)
    assert C.parse(C.render(C.fold_events(empty))).count() == 0
