import numpy as np
import pytest

from docloom.llm import neighbours

SCHEMA = "uid string, dense array<float>, cosine string"


def table(spark, rows):
    return spark.createDataFrame([(u, None if x is None else [float(v) for v in x], "clash") for u, x in rows], SCHEMA)


def brute(rows, k, least=-1.0):
    seen = {}
    for u, x in rows:
        if x is not None and len(x) == 8 and np.isfinite(x).all() and np.any(x):
            seen[u] = np.asarray(x, dtype=np.float32).astype(float)
    names = sorted(seen)
    m = np.stack([seen[u] / np.linalg.norm(seen[u]) for u in names])
    s = m @ m.T
    return {u: [(names[j], s[i, j]) for j in sorted((j for j in range(len(names)) if j != i and s[i, j] >= least - 1e-9), key=lambda j: (-s[i, j], names[j]))[:k]] for i, u in enumerate(names)}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    x[1::3] = x[::3] + rng.normal(size=(300, 8)) * 0.05
    return [(f"u{i:04d}", v * rng.uniform(0.1, 9)) for i, v in enumerate(x)]


def test_factor_one_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_SHARD_ROWS", 100)
    got = neighbours.nearest_neighbours(table(spark, rows), "uid", "dense", 8, k=5, factor=1.0, least_cosine=0.8).collect()
    want = {(u, o) for u, near in brute(rows, 5, 0.8).items() for o, _ in near}
    assert {(r.uid, r.other) for r in got} == want and len(got) == len(want)


def test_relaxed_recall(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 32)
    got = neighbours.nearest_neighbours(table(spark, rows), "uid", "dense", 8, k=10, factor=0.4).collect()
    want = {(u, o) for u, near in brute(rows, 10).items() for o, _ in near}
    found = {(r.uid, r.other) for r in got}
    assert len(found & want) >= 0.9 * len(want) and len(got) == 9000


def test_tree_descends_by_the_triangle_inequality(rows):
    x = neighbours._unit(np.stack([v for _, v in rows]))
    root, order = neighbours.build_tree(x, 16)
    top = neighbours.search(root, x[order], x, 3, 1.0, -1.0)
    exact = -np.sort(-(x @ x.T), axis=1)[:, :3]
    assert np.allclose(top.cos, exact, atol=1e-5)


def test_dirty_vectors_copies_and_asking(spark):
    same, other = [1.0] * 8, [1.0] * 7 + [-1.0]
    rows = [(f"c{i:02d}", same) for i in range(20)] + [("o", other), ("o", other), ("n", None), ("z", [0.0] * 8), ("w", [1.0] * 7), ("e", []), ("x", [float("nan")] + [1.0] * 7), ("i", [float("inf")] + [1.0] * 7), (None, same)]
    got = neighbours.nearest_neighbours(table(spark, rows).repartition(4), "uid", "dense", 8, k=3).collect()
    near = {}
    for r in got:
        near.setdefault(r.uid, []).append((r.other, round(r.cosine, 6)))
    assert set(near) == {f"c{i:02d}" for i in range(20)} | {"o"}
    assert sorted(near["c00"]) == [("c01", 1.0), ("c02", 1.0), ("c03", 1.0)]
    assert sorted(near["c19"]) == [("c00", 1.0), ("c01", 1.0), ("c02", 1.0)]
    assert sorted(near["o"]) == [("c00", 0.75), ("c01", 0.75), ("c02", 0.75)]
    some = neighbours.nearest_neighbours(table(spark, rows), "uid", "dense", 8, k=3, asks=lambda u: u == "c19").collect()
    assert sorted(r.other for r in some) == ["c00", "c01", "c02"] and {r.uid for r in some} == {"c19"}


def test_busy_shards_are_searched_by_several_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_SHARD_ROWS", 100)
    monkeypatch.setattr(neighbours, "VISITORS", 1)
    got = neighbours.nearest_neighbours(table(spark, rows).repartition(3), "uid", "dense", 8, k=5, factor=1.0, least_cosine=0.8).collect()
    want = {(u, o) for u, near in brute(rows, 5, 0.8).items() for o, _ in near}
    assert {(r.uid, r.other) for r in got} == want and len(got) == len(want)


def test_empty_table_and_pairs(spark):
    assert neighbours.nearest_neighbours(table(spark, []), "uid", "dense", 8).count() == 0
    pairs = neighbours.similar_pairs(table(spark, [("b", [1] * 8), ("a", [1] * 7 + [1.1]), ("c", [-1] * 8)]), "uid", "dense", 8).collect()
    assert [(p.uid_a, p.uid_b) for p in pairs] == [("a", "b")]


def test_recall_in_few_dimensions_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_SHARD_ROWS", 60)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4)) @ np.linalg.qr(rng.normal(size=(64, 4)))[0].T
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    np.fill_diagonal(c, -2)
    want = {(f"{i:05d}", f"{j:05d}") for i in range(len(x)) for j in np.argsort(-c[i])[:10] if c[i, j] >= 0.95}
    df = spark.createDataFrame([(f"{i:05d}", r.tolist()) for i, r in enumerate(x)], "uid string, dense array<float>")
    got = {(r.uid, r.other) for r in neighbours.nearest_neighbours(df, "uid", "dense", least_cosine=0.95, shard_rows=60).collect()}
    assert len(want & got) >= 0.86 * len(want)


def test_home_shard_first_then_the_shards_within_reach(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_SHARD_ROWS", 100)
    got = neighbours.nearest_neighbours(table(spark, rows), "uid", "dense", 8, k=5, factor=1.0, route_factor=1.0).collect()
    want = {(u, o) for u, near in brute(rows, 5).items() for o, _ in near}
    assert {(r.uid, r.other) for r in got} == want and len(got) == len(want)


def test_overfull_shards_are_kept_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_SHARDS", 4)
    monkeypatch.setattr(neighbours, "LEAST_SHARD_ROWS", 10)
    copies = rows + [(f"copy{i}", rows[0][1]) for i in range(30)]
    for least in (0.8, -1.0):
        got = neighbours.nearest_neighbours(table(spark, copies), "uid", "dense", 8, k=5, factor=1.0, route_factor=1.0, least_cosine=least, shard_rows=20).collect()
        want = {(u, o) for u, near in brute(copies, 5, least).items() for o, _ in near}
        assert {(r.uid, r.other) for r in got} == want and len(got) == len(want)


def test_what_shards_hold_is_counted(spark):
    root, _ = neighbours.build_tree(neighbours._unit(np.random.default_rng(0).normal(size=(64, 8))), 16)
    for i, leaf in enumerate(neighbours.leaves(root)):
        leaf.shard = i
    neighbours.balance(root, spark.createDataFrame([(0, 500, 10), (0, 500, 10), (1, 10, 900_000)], "shard long, stored long, visits long"), 100)
    assert [(leaf.parts, leaf.salts) for leaf in neighbours.leaves(root)] == [(5, 1), (1, 23), (1, 1), (1, 1)]
