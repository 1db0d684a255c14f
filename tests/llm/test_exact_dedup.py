import hashlib

from pyspark.sql import functions as F

from ledgerlume.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, keep_id string, digest int"


def rows(spark, data):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in data], SCHEMA)


def test_groups_keep_the_largest_id_and_treat_null_as_empty(spark):
    got = {r.doc_id: r for r in X.exact_groups(rows(spark, [(1, "a"), (5, "a"), (2, None), (3, ""), (4, "A"), (6, "x" * 100_000)])).collect()}
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {
        1: (5, 2, False), 5: (5, 2, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True), 6: (6, 1, True),
    }
    assert bytes(got[2].digest) == hashlib.sha256(b"").digest()


def test_weak_digest_is_resolved_by_whole_texts(spark):
    docs = rows(spark, [(1, "aa"), (2, "ab"), (3, "aa"), (4, "ba"), (5, None)])
    weak = lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 2, "0"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.exact_groups(docs, weak).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1)}


def test_empty_table_repeats_null_ids_and_extra_columns(spark):
    assert X.exact_groups(rows(spark, [])).count() == 0
    kept = X.deduplicate(rows(spark, [(1, "a"), (1, "a"), (None, "b"), (2, "a")]))
    assert kept.columns == ["doc_id", "text", "keep_id", "digest"]
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "b"), (2, "a")]


def test_clashing_names_and_ids_that_are_null_or_repeat(spark):
    data = [(None, "b"), (None, "c"), (None, "c"), (1, "a"), (1, "z"), (2, "a"), (2, "a"), (3, None), (None, "")]
    names = "doc_id long, text string, stays_id long, file string, row int, stays int, hit_file int, group_size long, content int, size int"
    kept = X.deduplicate(spark.createDataFrame([(i, t, 9, "f", 1, 1, 1, 1, 1, 1) for i, t in data], names))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "b"), (None, "c"), (1, "z"), (2, "a"), (3, None)], key=str)
    assert kept.columns == names.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_locators_fetch_the_rows_that_stay(spark, tmp_path):
    at = f"{tmp_path}/docs"
    rows(spark, [(i, f"t{i % 7}") for i in range(40)]).repartition(3).write.parquet(at)
    groups = X.located_groups(X.located(spark.read.parquet(at)))
    wanted = groups.select("stays.file", "stays.row", "stays.doc_id").distinct()
    seen = spark.read.parquet(at).selectExpr("_metadata.file_path AS file", "_metadata.row_index AS row", "doc_id AS id", "text")
    got = sorted((r.doc_id, r.id, r.text) for r in wanted.join(seen, ["file", "row"]).collect())
    assert got == [(i, i, f"t{i % 7}") for i in range(33, 40)]


def test_texts_are_not_shuffled_where_few_rows_go(spark, tmp_path):
    at = f"{tmp_path}/docs"
    rows(spark, [(i, f"t{i % 7}") for i in range(40)]).write.parquet(at)
    plan = X.deduplicate(spark.read.parquet(at))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_hot_digests_and_a_hot_bound(spark, monkeypatch):
    from ledgerlume.llm import joins

    monkeypatch.setattr(joins, "HOT", 4)  # digests with over a quarter of all rows are hot
    data = [(i, "hot" if i % 2 else f"t{i % 10}") for i in range(60)]
    best, n = {}, {}
    for i, t in data:
        best[t], n[t] = max(i, best.get(t, 0)), n.get(t, 0) + 1
    got = {r.doc_id: (r.keep_id, r.group_size) for r in X.exact_groups(rows(spark, data)).collect()}
    assert got == {i: (best[t], n[t]) for i, t in data}


def test_state_survives_between_batches(spark, tmp_path):
    at, ckpt = f"{tmp_path}/log", f"{tmp_path}/state"
    log = X.digest_log(X.located(rows(spark, [(1, "a"), (2, "b")])))
    log.write.parquet(at)
    X.keyed_state(spark, at, ckpt, log.schema).collect()
    X.digest_log(X.located(rows(spark, [(9, "a")]))).write.mode("append").parquet(at)
    got = {(r.stays.doc_id, r.group_size) for r in X.keyed_state(spark, at, ckpt, log.schema).collect()}
    assert got == {(9, 2), (2, 1)}


def test_derived_tables_lose_no_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "a\nb"), (2, "a\nc"), (3, "d\nd")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    lines = table.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    assert sorted(map(tuple, X.deduplicate(lines).collect())) == [(1, "b"), (2, "a"), (2, "c"), (3, "d")]
    twice = table.join(spark.createDataFrame([(1,), (1,), (2,)], "doc_id long"), "doc_id")
    assert sorted(map(tuple, X.deduplicate(twice).collect())) == [(1, "a\nb"), (2, "a\nc")]
    assert X.deduplicate(table.union(table)).count() == 3
    assert X.rows_of_files(table.filter("doc_id > 1").select("text", "doc_id")) and not X.rows_of_files(lines)
