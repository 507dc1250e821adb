import datetime as dt
import random

from docloom.operators import snapshots as S

SCHEMA = "snapshot_no int, section_id string, source_hash string, semantic_hash string, delivered_at timestamp, no string, key string"
T0 = dt.datetime(2025, 1, 1)


def run(spark, rows):
    df = spark.createDataFrame([(n, k, a, b, T0 + dt.timedelta(hours=h), "x", "y") for n, k, a, b, h in rows], SCHEMA)
    got = S.snapshot_changes(df).collect()
    assert len(got) == len(set(got))
    return {(r.snapshot_no, r.section_id, r.change_kind) for r in got}


def brute(rows):
    low = lambda x: None if x is None else x.lower()
    table = {}
    for n, k, a, b, h in rows:
        if n is None or k is None:
            continue
        new = (h, low(a) or "", low(b) or "", low(a), low(b))
        if (n, k) not in table or new > table[n, k]:
            table[n, k] = new
    numbers = sorted({n for n, _ in table})
    out = set()
    for p, n in zip(numbers, numbers[1:]):
        for k in {k for _, k in table}:
            x, y = table.get((p, k)), table.get((n, k))
            if x and not y:
                out.add((n, k, "removed"))
            elif y and not x:
                out.add((n, k, "added"))
            elif x and y:
                (a, b), (c, d) = x[3:], y[3:]
                source = a is not None and c is not None and a != c
                if b is not None and d is not None:
                    kind = "changed" if b != d else "reformatted" if source else None
                else:
                    kind = "changed" if source else None
                if kind:
                    out.add((n, k, kind))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    for numbers in ([1, 2, 3, 4, 5, 6], [2, 3, 7]):
        rows = [(rng.choice(numbers), f"s{rng.randint(0, 40)}", rng.choice(["a", "A", "b", None]), rng.choice(["x", "X", "y", None]), rng.randint(0, 9)) for _ in range(400)]
        rows += rows[:60] + [(None, "s1", "a", "x", 1), (numbers[0], None, "a", "x", 1)]
        assert run(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, "a", "x", "y", 0)] * 3) == set()
