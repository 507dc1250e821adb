import random

from docloom.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w), "x") for a, b, w in rows], "src string, dst string, weight double, node string")


def brute_components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in rows:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


def test_components_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"n{rng.randint(0, 90):02d}", f"n{rng.randint(0, 90):02d}", 1) for _ in range(70)]
    rows += [("hub", f"h{i}", 1) for i in range(60)] + [("z", "z", 1), (None, "a", 1), ("a", None, 1)] + rows[:9]
    rows += [(f"p{i:02d}", f"p{i + 1:02d}", 1) for i in range(40)]
    got = {r.node: r.component for r in G.components(edges(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_components_of_nothing(spark):
    assert G.components(edges(spark, [])).count() == 0


def test_bfs(spark):
    rows = [("a", "b", 1), ("b", "c", 1), ("d", "c", 1), ("d", "e", 1), ("a", "a", 1), (None, "a", 1), ("x", "y", 1)]
    seeds = spark.createDataFrame([("a",), ("a",), (None,), ("lonely",)], "node string")
    got = {(r.node, r.hop) for r in G.bounded_bfs(edges(spark, rows), seeds, 3).collect()}
    assert got == {("a", 0), ("lonely", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_label_propagation_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"n{rng.randint(0, 20)}", f"n{rng.randint(0, 20)}", rng.randint(1, 3)) for _ in range(60)]
    weight = {}
    for a, b, w in rows:
        if a != b:
            for p in ((a, b), (b, a)):
                weight[p] = max(weight.get(p, 0), w)
    label = {a: a for a, _ in weight}
    for _ in range(4):
        new = {}
        for n in label:
            votes = {}
            for (a, b), w in weight.items():
                if a == n:
                    votes[label[b]] = votes.get(label[b], 0) + w
            new[n] = min(votes, key=lambda x: (-votes[x], x != label[n], x))
        label = new
    assert {r.node: r.label for r in G.label_propagation(edges(spark, rows)).collect()} == label


def test_cycles_and_degrees(spark):
    rows = [("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("b", "c", 1), ("c", "c", 1), (None, "c", 1)]
    assert [(r.a, r.b) for r in G.short_cycles(edges(spark, rows)).collect()] == [("a", "b")]
    assert {(r.node, r.out_degree, r.in_degree) for r in G.degrees(edges(spark, rows)).collect()} == {("a", 1, 1), ("b", 2, 1), ("c", 0, 1)}


def test_cycles_of_any_bounded_length(spark):
    rng = random.Random(9)
    rows = [(f"n{rng.randint(0, 11):02d}", f"n{rng.randint(0, 11):02d}", 1) for _ in range(36)] + [(None, "n01", 1), ("n01", None, 1)]
    out = {}
    for a, b, _ in rows:
        if a and b:
            out.setdefault(a, set()).add(b)
    want = set()

    def walk(path):
        for n in out.get(path[-1], ()):
            if n == path[0]:
                want.add(tuple(path))
            elif n > path[0] and n not in path and len(path) < 5:
                walk([*path, n])

    for a in out:
        walk([a])
    got = [tuple(r.nodes) for r in G.bounded_cycles(edges(spark, rows + rows[:5]), 5).collect()]
    assert set(got) == want and len(got) == len(want) and max(map(len, want)) == 5
    assert G.bounded_cycles(edges(spark, []), 4).count() == 0


def test_components_that_do_not_converge_are_an_error(spark):
    import pytest

    with pytest.raises(RuntimeError):
        G.components(edges(spark, [(f"p{i:02d}", f"p{i + 1:02d}", 1) for i in range(40)]), rounds=1)
