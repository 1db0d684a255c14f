from ledgerlume.operators import versions as V

SCHEMA = "document int, seq int, label string, snapshot map<string,string>"


def test_changes_with_removed_and_null_fields(spark):
    rows = [(1, 5, "b", {"x": "1", "y": None}), (1, 2, "a", {"x": "0", "z": "9"}), (1, 9, "b", {"x": "1", "y": None}), (2, 1, "a", None), (2, 3, "a", {"q": ""})]
    numbered = V.versions(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in V.changes(numbered).collect()} == {
        (1, 1, "ADICIONADO", "x", None, "0"), (1, 1, "ADICIONADO", "z", None, "9"),
        (1, 2, "ALTERADO", "x", "0", "1"), (1, 2, "ADICIONADO", "y", None, "null"), (1, 2, "REMOVIDO", "z", "9", None),
        (2, 2, "ADICIONADO", "q", None, ""),
    }
    assert {tuple(r) for r in V.compare(numbered, 3, 1).collect()} == {(1, "x", "1", "0"), (1, "y", "null", None), (1, "z", None, "9")}
    assert V.compare(numbered, 2, 2).count() == 0
    assert [(r.document, r.version, r.snapshot) for r in V.as_of(numbered, "b").collect()] == [(1, 3, {"x": "1", "y": None})]


def test_no_versions(spark):
    numbered = V.versions(spark.createDataFrame([], SCHEMA))
    assert V.changes(numbered).count() == 0 and V.compare(numbered, 1, 2).count() == 0
