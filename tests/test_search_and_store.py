import datetime as dt
import math
import random

import numpy as np

from docloom.operators import candidates as K
from docloom.operators import events as E
from docloom.operators import rules as R
from docloom.operators import search as S
from docloom.operators import store as O


def test_dense_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[10:20] = x[0]
    rows = spark.createDataFrame([(i, [float(v) for v in r], "c") for i, r in enumerate(x)] + [(900, None, "c"), (901, [1.0], "c"), (902, [0.0] * 6, "c"), (903, [float("nan")] * 6, "c")], "row_id long, x array<double>, rank string")
    queries = rows.where("row_id in (0, 5, 77)").select(rows.row_id.alias("query_id"), "x")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, i) for q in (0, 5, 77) for i in sorted((i for i in range(300) if round(float(n[q] @ n[i]), 6) > 0), key=lambda i: (-round(float(n[q] @ n[i]), 6), i))[:7]}
    assert {(r.query_id, r.row_id) for r in S.dense_top_k(rows, queries, 7, 6).collect()} == want
    monkeypatch.setattr(S, "QUERY_ROWS", 2)
    assert {(r.query_id, r.row_id) for r in S.dense_top_k(rows, queries, 7, 6).collect()} == want
    assert S.dense_top_k(rows, queries, 0, 6).count() == 0 and S.dense_top_k(rows, queries.limit(0), 3, 6).count() == 0 and S.dense_top_k(rows.limit(0), queries, 3, 6).count() == 0


def test_bm25_against_brute_force(spark):
    docs = {"a": "x x y", "b": "y z", "c": "z z z w", "d": "q"}
    query = {"x": 1, "z": 2, "nope": 1}
    rows = spark.createDataFrame([(d, docs[d].split(), "c") for d in docs] + [("e", [], "c"), ("f", None, "c")], "row_id string, terms array<string>, rank string")
    q = spark.createDataFrame([(1, t, n) for t, n in query.items()], "query_id int, token string, n long")
    mean = sum(len(v.split()) for v in docs.values()) / 4
    want = {}
    for d, text in docs.items():
        s = 0.0
        for t, qn in query.items():
            tf, df = text.split().count(t), sum(t in v.split() for v in docs.values())
            if tf:
                s += qn * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(text.split()) / mean))
        if s > 0:
            want[d] = round(s, 6)
    assert {r.row_id: r.score for r in S.bm25_top_k(rows, q, 9).collect()} == want
    assert S.bm25_top_k(rows.limit(0), q, 9).count() == 0 and S.bm25_top_k(rows, q.limit(0), 9).count() == 0


def test_terms_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 40)
    monkeypatch.setattr(S, "TERM_QUERIES", 3)
    rng = random.Random(4)
    docs = {f"r{i:03d}": [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for i in range(200)}
    asked = {q: {t: rng.randint(1, 3) for t in rng.sample("abcdefgh", 3)} for q in range(8)}
    rows = spark.createDataFrame([(k, v + [None]) for k, v in docs.items()] + [("null", None), (None, ["a"])], "row_id string, terms array<string>").repartition(5)
    queries = spark.createDataFrame([(q, t, float(w)) for q, own in asked.items() for t, w in own.items()], "query_id int, term string, weight double")
    want = {(q, r, n + 1) for q, own in asked.items() for n, (_, r) in enumerate(sorted((-sum(own.get(t, 0) for t in v), r) for r, v in docs.items() if any(t in own for t in v))[:6])}
    assert {(r.query_id, r.row_id, r["rank"]) for r in S.term_top_k(rows, queries, 6).collect()} == want
    weighted = spark.createDataFrame([("x", [1, 2], [0.5, 2.0]), ("y", [2, 3], [1.0, -4.0])], "row_id string, terms array<int>, weights array<double>")
    got = S.term_top_k(weighted, spark.createDataFrame([(7, 2, 3.0), (7, 3, 1.0)], "query_id int, term int, weight double"), 5).collect()
    assert [(r.row_id, r.score) for r in got] == [("x", 6.0)]


def test_dense_vectors_of_other_sizes_do_not_decide_for_the_rest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0])], "row_id int, x array<double>")
    queries = rows.selectExpr("row_id AS query_id", "x")
    assert {(r.query_id, r.row_id) for r in S.dense_top_k(rows, queries, 3, 2).collect()} == {(1, 1), (2, 2)}
    assert [r.query_id for r in queries.where(~S.fitting(queries, 2)).collect()] == [3]


def test_dense_gate_keeps_hits_without_a_dense_score(spark):
    hits = spark.createDataFrame([("q", "q", 0.9, 1.0, 1), ("q", "a", 0.8, 0.5, 2), ("q", "b", 0.7, None, 3), ("q", "c", 0.6, 0.6, 4), ("q", "d", 0.5, 0.9, 5)], "query_id string, row_id string, score double, dense_score double, rank int")
    assert [(r.row_id, r["rank"]) for r in S.dense_gate(hits, 0.55, 2).orderBy("rank").collect()] == [("b", 1), ("c", 2)]


def test_fusion_ranks_and_ties(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, row_id string, score double, rank int")
    got = S.fuse({"a": hits([(1, "x", 3.0, 1), (1, "y", 2.0, 2)]), "b": hits([(1, "y", 9.0, 1), (1, "z", 1.0, 2)])}, 3).orderBy("rank").collect()
    assert [(r.row_id, r.a_rank, r.b_rank) for r in got] == [("y", 2, 1), ("x", 1, None), ("z", None, 2)]
    assert S.top_k(hits([(1, "b", 1.0, 0), (1, "a", 1.0, 0)]).drop("rank"), 1).first().row_id == "a"


SCHEMA = "candidate_id long, source_section_id string, target_section_id string, channels array<string>, evidence_terms array<string>, score string"


def test_candidates(spark):
    rows = [(1, "a", "b", ["search_key_match", None], ["t1", "t2"], "x"), (2, "a", "b", ["markdown_link", "search_key_match"], ["t2", " ", None], "x"), (3, "a", "a", ["markdown_link"], None, "x"), (4, "a", " ", ["markdown_link"], None, "x"), (5, None, "b", None, None, "x"), (6, "a", "c", None, None, "x"), (7, "a", "d", ["new_channel"], ["t"] * 50, "x")]
    merged = K.merge_channels(spark.createDataFrame(rows + rows[:2], SCHEMA))
    got = {r.target_section_id: (r.channels, r.n_terms, r.score, r.exact) for r in merged.collect()}
    assert got == {"b": (["markdown_link", "search_key_match"], 2, 101.5, True), "c": ([], 0, 0.0, False), "d": (["new_channel"], 1, 0.25, False)}
    assert [(r.target_section_id, r.place) for r in K.limit_per_source(merged, 2).orderBy("place").collect()] == [("b", 1), ("d", 2)]
    assert [tuple(r) for r in K.dropped_report(merged, 2).collect()] == [("a", 2, 1)]
    assert {r.target_section_id for r in K.gate(merged, 0.2, 1).collect()} == {"b"}
    assert K.merge_channels(spark.createDataFrame([], SCHEMA)).count() == 0


def test_store(spark):
    table = lambda rows: spark.createDataFrame(rows, "k string, a string, b int")
    old, new = table([("1", "x", 1), ("2", "x", None), ("3", "y", 3), ("4", "z", 4)]), table([("1", "x", 1), ("2", None, 2), ("3", "y", 9), ("5", "n", 5)])
    diff = {(r.k, r.change, r.first_column) for r in O.keyed_diff(old, new, "k", ["a", "b"]).collect()}
    assert diff == {("2", "changed", "a"), ("3", "changed", "b"), ("4", "removed", None), ("5", "added", None)}
    again = O.upsert(old, new.where("k <> '1'"), table([("4", None, None)]), "k")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, new.collect()), key=str)
    assert {(r.k, r.issue, tuple(r.fields)) for r in O.verify(old, new, "k", ["a", "b"]).collect()} == {("2", "mismatch", ("a", "b")), ("3", "mismatch", ("b",)), ("4", "missing", ()), ("5", "stale", ())}
    assert {(r.k, r.a) for r in O.patch_column(old, new, "k", "a").collect()} == {("1", "x"), ("2", "x"), ("3", "y"), ("4", "z")}
    prints = lambda df: {(r.a, r.rows, r.fingerprint) for r in O.fingerprint(df, "a", ["k", "b"]).collect()}
    assert prints(old) == prints(old.repartition(5)) and prints(old) != prints(old.withColumn("b", old.b + 1))


def test_renames(spark):
    table = lambda rows: spark.createDataFrame(rows, "u string, k string, h string")
    got = O.renames(table([("1", "a", "x"), ("2", "b", "x"), ("3", "c", None), ("4", "d", "x"), ("4", "e", "x")]), table([("1", "a2", "x"), ("2", "b", "y"), ("3", "c2", "y"), ("4", "d2", "x")]), "u", "k", "h")
    assert {(r.u, r.kind) for r in got.collect()} == {("1", "renamed"), ("2", "edited"), ("3", "renamed")}


def test_events_against_brute_force(spark):
    rng = random.Random(2)
    t0 = dt.datetime(2025, 1, 1)
    rows = [(f"u{rng.randint(0, 4)}" if rng.random() > 0.1 else None, t0 + dt.timedelta(minutes=rng.randint(0, 600)), i, rng.choice("ab")) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, kind string")
    queue = {r.k: r.last_change for r in E.change_queue(df, "k", "ts", "id", "kind").collect()}
    assert queue == {k: max((t, i, c) for kk, t, i, c in rows if kk == k)[2] for k in {r[0] for r in rows} - {None}}
    want = 0
    for k in queue:
        times = sorted(t for kk, t, _, _ in rows if kk == k)
        want += 1 + sum((b - a) > dt.timedelta(minutes=30) for a, b in zip(times, times[1:]))
    assert E.quiet_sessions(df, "k", "ts", "30 minutes").count() == want
    assert E.expired(df.limit(0), "k", "ts", "1 HOUR").count() == 0


def test_rules(spark):
    rows = [("d", 1, "s1", "A must not stop."), ("d", 2, "s2", "B must run and wait 50 s."), ("e", 1, "s3", "C shall go"), ("e", 2, "s4", "not exceed 10 and wait 3"), ("d", 3, "s5", "may not exceed 40 rows"), (None, 1, "s6", "must"), ("f", 1, "s7", None)]
    df = spark.createDataFrame(rows, "doc string, n int, id string, text string")
    assert [tuple(r) for r in R.modal_conflicts(df, "doc", "n", "id").collect()] == [("d", "s2", "s1")]
    assert {tuple(r) for r in R.numeric_bounds(df, "doc").collect()} == {("d", 40, 50, True), ("e", 10, 3, False)}


def test_limits_of_the_reference(spark, tmp_path):
    from compare import difference
    from docloom.plans import corpus

    row = lambda source, k, channel: (source, f"t{k:02d}", [channel], ["x"] * (k % 2))
    rows = [row("a", k, "search_key_match") for k in range(40)] + [row("b", k, "qdrant_section_hybrid") for k in range(10)] + [row("c", k, "markdown_link") for k in range(9)]
    spark.createDataFrame(rows, "source_section_id string, target_section_id string, channels array<string>, evidence_terms array<string>").coalesce(1).write.parquet(str(tmp_path / "related_section_candidates.parquet"))
    d = str(tmp_path)
    kept = {r["source_section_id"]: r["count"] for r in corpus.candidate_limit_32(spark, d).groupBy("source_section_id").count().collect()}
    assert kept == {"a": 32, "b": 10, "c": 9}
    assert [tuple(r) for r in corpus.candidate_dropped_32(spark, d).collect()] == [("a", 32, 8)]
    passed = {r["source_section_id"]: r["count"] for r in corpus.candidate_gate_8(spark, d).groupBy("source_section_id").count().collect()}
    assert passed == {"a": 8, "b": 8, "c": 9}
    for name in ("candidate_limit_32", "candidate_dropped_32", "candidate_gate_8"):
        assert difference(spark, name, corpus.QUERIES[name], corpus.SQL[name], d) is None


def test_global_cap_spares_what_is_exempt(spark):
    ends = "left_id string, right_id string"
    pairs = spark.createDataFrame([("b", "a", "section_pair_retrieval"), ("a", "b", "section_pair_retrieval"), ("c", "a", "section_pair_retrieval"), ("d", "a", "section_pair_retrieval"), (None, "a", "section_pair_retrieval")], f"{ends}, origin string")
    exempt = [(spark.createDataFrame([("a", "a"), ("b", "a")], ends), "all_pairs"), (spark.createDataFrame([("c", "a")], ends), "existing_conflict_recheck")]
    every = {(r.left_id, r.right_id): (r.pair_id, r.origin) for r in K.capped_union(pairs, exempt, -1).collect()}
    assert {k: v[1] for k, v in every.items()} == {("a", "b"): "section_pair_retrieval", ("a", "c"): "existing_conflict_recheck", ("a", "d"): "section_pair_retrieval", ("a", "a"): "all_pairs"}
    none = {(r.left_id, r.right_id): r.origin for r in K.capped_union(pairs, exempt, 0).collect()}
    assert none == {("a", "a"): "all_pairs", ("a", "b"): "all_pairs", ("a", "c"): "existing_conflict_recheck"}
    one = {(r.left_id, r.right_id) for r in K.capped_union(pairs, [], 1).collect()}
    assert one == {min((k for k in every if every[k][1] != "all_pairs"), key=lambda k: every[k][0])}


def test_fallback_only_where_nothing_is_selected(spark):
    rows = lambda r: spark.createDataFrame(r, "s string, t string")
    got = K.with_fallback(rows([("a", "x")]), rows([("a", "y"), ("b", "z")]), "s").collect()
    assert {(r.s, r.t, r.origin) for r in got} == {("a", "x", "selected"), ("b", "z", "fallback")}
