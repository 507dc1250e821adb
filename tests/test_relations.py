from docloom.operators import relations as L


def test_verdicts(spark):
    rows = [(1, "a", "b"), (2, " ", "b"), (3, "a", None), (4, "a", "a"), (5, "x", "a"), (6, "a", "x"), (1, "a", "b")]
    c = spark.createDataFrame(rows, "candidate_id long, source_section_id string, target_section_id string")
    live = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "section_id string")
    got = {(r.candidate_id, r.verdict) for r in L.validate_targets(c, live).collect()}
    assert got == {(1, "kept"), (2, "blank_source"), (3, "blank_target"), (4, "self"), (5, "unknown_source"), (6, "unknown_target")}


def test_inherit(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    keys = lambda rows: spark.createDataFrame([(r,) for r in rows], "key string")
    got = L.inherit(pairs([("a", "b"), ("a", "gone"), ("c", "b")]), pairs([("c", "d"), ("a", "z")]), keys(["c"]), keys(["a", "b", "c", "d"]))
    assert {tuple(r) for r in got.collect()} == {("a", "b", "inherited"), ("c", "d", "recomputed")}


def test_reconcile(spark):
    table = lambda rows: spark.createDataFrame(rows, "k string, u string, s string, m string")
    before = table([("1", "u1", "x", "m"), ("2", "u2", "x", "m"), ("3", "u3", "x", "m"), ("4", "u4", "x", "m"), ("5", "u5", "x", None), ("6", "dup", "x", "m"), ("7", "dup", "x", "m"), ("8", None, "x", "m")])
    after = table([("1", "u1", "x", "m"), ("2", "u2", "y", "m"), ("3", "u3", "y", "n"), ("4b", "u4", "z", "q"), ("5", "u5", "X", "m"), ("6b", "dup", "x", "m"), ("9", None, "x", "m")])
    got = {(r.old_key, r.new_key, r.state) for r in L.reconcile(before, after, "k", "u", "s", "m").collect()}
    assert got == {("1", "1", "unchanged"), ("2", "2", "format_only"), ("3", "3", "changed"), ("4", "4b", "renamed"), ("5", "5", "unchanged"), ("6", None, "removed"), ("7", None, "removed"), (None, "6b", "added"), ("8", None, "removed"), (None, "9", "added")}


def test_groups(spark):
    rows = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), (None, "a"), ("h", "z"), ("h", "z"), ("h", "y")], "g string, v string")
    assert {tuple(r) for r in L.dominant(rows, "g", "v").collect()} == {("g", "a", 1), ("h", "z", 2)}
    got = L.coverage(rows, spark.createDataFrame([("a",), ("a",), ("z",)], "v string"), "g", "v")
    assert {(r.g, r.members, r.covered, r.level) for r in got.collect()} == {("g", 3, 1, "medium"), ("h", 2, 1, "medium")}
    keyed = L.batches(rows.where("g = 'h'"), "g", ["v"], 2)
    assert sorted(r.batch for r in keyed.collect()) == [0, 0, 1]
    probe = L.cache_probe(rows.select("v").where("v IS NOT NULL").distinct(), spark.createDataFrame([("a",), (None,)], "v string"), "v")
    assert {(r.v, r.hit) for r in probe.collect()} == {("a", True), ("b", False), ("y", False), ("z", False)}


def test_batches_of_a_hot_group(spark):
    rows = [("hot", i, "x") for i in range(900)] + [("b", i, "x") for i in range(7)] + [(None, i, "x") for i in range(7)]
    df = spark.createDataFrame(rows, "g string, n int, batch0 string").repartition(5)
    got = {(r.g, r.n): r.batch for r in L.batches(df, "g", ["n"], 4).collect()}
    assert got == {(g, n): n // 4 for g, n, _ in rows}
    assert L.batches(df.limit(0), "g", ["n"], 4).count() == 0
