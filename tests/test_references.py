import datetime as dt
import random

from docloom.operators import references as R

REFS = "ref_table string, record_id string, ref_field string, ref_id string, ref_at timestamp, delta string"
RECORDS = "section_id string, ingested_at timestamp, deleted_at timestamp, at string"
T0 = dt.datetime(2025, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def run(spark, refs, records, **kw):
    r = spark.createDataFrame([("t", str(i), "f", k, at(h), "x") for i, k, h in refs], REFS)
    s = spark.createDataFrame([(k, at(a), at(b), "x") for k, a, b in records], RECORDS)
    rows = R.orphan_references(r, s, **kw).collect()
    assert len(rows) == len(set(rows))
    return {int(x.record_id) for x in rows}


def brute(refs, records):
    out = set()
    for i, k, h in refs:
        if k is None or not k.strip():
            continue
        own = [(a, b) for key, a, b in records if key == k]
        ok = bool(own) if h is None else any(a is not None and a <= h and (b is None or b > h) for a, b in own)
        if not ok:
            out.add(i)
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    time = lambda: rng.choice([None, *[x / 4 for x in range(60)]])
    keys = ["a", "b", "c", "D", "d", " d", "e", None, "", "  ", "　"]
    records = [(rng.choice(keys[:7]), time(), time()) for _ in range(25)]
    records += records[:8]
    refs = [(i, "a" if i % 3 == 0 else rng.choice(keys), time()) for i in range(500)]
    refs += refs[:100]
    for seconds in (900, 3600, 86400):
        assert run(spark, refs, records, bucket_seconds=seconds) == brute(refs, records)


def test_edges(spark):
    records = [("a", 1, 2), ("a", 5, None), ("n", None, None), ("r", 3, 3)]
    refs = [(1, "a", 1), (2, "a", 2), (3, "a", 0.5), (4, "a", 9), (5, "a", None), (6, "n", 4), (7, "n", None), (8, "r", 3), (9, "x", None)]
    assert run(spark, refs, records) == {2, 3, 6, 8, 9}


def test_empty_tables(spark):
    assert run(spark, [], [("a", 1, None)]) == set()
    assert run(spark, [(1, "a", 1), (2, "a", None)], []) == {1, 2}


def test_counts_are_maintained_from_deltas(spark):
    state = spark.createDataFrame([("a", 2, 1), ("b", 1, 0)], "ref_id string, refs long, existing long")
    delta = spark.createDataFrame([("a", 0, -1), ("b", -1, 0), ("c", 3, 1), ("c", 0, -1)], "ref_id string, refs long, existing long")
    new = R.apply_deltas(state, delta)
    assert sorted((r.ref_id, r.refs, r.existing) for r in new.collect()) == [("a", 2, 0), ("c", 3, 0)]
    assert sorted(r.ref_id for r in R.current_orphans(new).collect()) == ["a", "c"]


def test_extraction_of_dirty_items(spark):
    schema = "conflict_id string, created_at timestamp, section_pair struct<left_section_id string, right_section_id string>, source_refs array<struct<source_ref string, source_section_id string>>, related_sections array<string>"
    rows = [("c", at(1), None, None, None), ("d", None, ("l", None), [("x", "s"), None, ("y", None)], ["r", None, " "])]
    got = R.conflict_references(spark.createDataFrame(rows, schema)).where(R.not_blank(R.F.col("ref_id")))
    assert sorted((r.record_id, r.ref_field, r.ref_id) for r in got.collect()) == [("d", "left_section_id", "l"), ("d", "related_sections", "r"), ("d", "source_refs", "s")]
