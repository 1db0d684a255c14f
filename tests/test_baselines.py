from ledgerlume.operators import baselines as B


def records(spark, **texts):
    return spark.createDataFrame(list(texts.items()) or [], "file string, record string")


def test_flattened(spark):
    text = '{"resultado": {"a": [1, {"b": null}, [true, 1.50]], "c": {}, "d": [], "e": "x"}, "erro": "", "roteamento": {"t": 2.0}}'
    got = {r.path: r.value for r in B.flattened(records(spark, f=text)).collect()}
    assert got == {"resultado.a.0": "1", "resultado.a.1.b": "null", "resultado.a.2.0": "true", "resultado.a.2.1": "1.5", "resultado.e": "x", "erro": "", "roteamento.t": "2"}
    assert {r.path: r.value for r in B.flattened(records(spark, f=None)).collect()} == dict.fromkeys(B.PARTS, "undefined")
    deep = {r.path: r.value for r in B.flattened(records(spark, f='{"erro": {"a": {"b": {"c": 1}}}}'), depth=3).collect()}
    assert deep["erro.a.b"] == '{"c":1}'


def test_changes_and_states(spark):
    before = records(spark, same='{"erro": {"x": 1, "timestamp": 1}}', order='{"erro": {"a": 1, "b": 2}}', gone="{}", plus='{"erro": {"a": 1}}', less='{"erro": {"a": [1, 2]}}', broken="{}")
    after = records(spark, same='{"erro": {"x": 1, "timestamp": 2}}', order='{"erro": {"b": 2, "a": 1}}', new="{}", plus='{"erro": {"a": 1, "b": null}}', less='{"erro": {"a": [1]}}', broken="{}")
    changed = B.changes(before, after)
    assert {tuple(r) for r in changed.collect()} == {("plus", "erro.b", None, "null"), ("less", "erro.a.1", "2", None)}
    states = B.file_states(before, after, changed, records(spark, plus=""))
    assert {r.file: (r.state, r.n_changes) for r in states.collect()} == {
        "same": ("IDENTICO", 0), "order": ("IDENTICO", 0), "gone": ("SUMIU", 0), "new": ("NOVO", 0), "plus": ("ESPERADO", 1), "less": ("ALTERADO", 1), "broken": ("IDENTICO", 0),
    }
    assert tuple(B.verdict(states).first()) == (6, 1, 2, 1, True)


def test_empty_runs(spark):
    none = records(spark)
    assert B.changes(none, none).count() == 0
    assert tuple(B.verdict(B.file_states(none, none, B.changes(none, none), none)).first()) == (0, 0, 0, 0, False)
