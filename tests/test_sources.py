import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.sources import files, versions
from docloom.streaming import changes as X


def test_scan_texts(spark, tmp_path):
    for name, text in {"a.md": "A\n", "sub/b.md": "B", "sub/c.txt": "C", "drafts/d.md": "D", "e.md": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.text for r in files.scan_texts(spark, str(tmp_path), ["*.md"], ["drafts/*"]).collect()}
    assert got == {"a.md": "A\n", "sub/b.md": "B"}
    with pytest.raises(FileNotFoundError):
        files.scan_texts(spark, str(tmp_path), ["*.rst"])
    with pytest.raises(ValueError):
        files.scan_texts(spark, str(tmp_path), ["../*.md"])


def test_read_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": "wrong"}\n{"b": "y"}\n')
    good, bad = files.read_records(spark, str(tmp_path / "r.json"), StructType([StructField("a", LongType()), StructField("b", StringType())]))
    assert sorted((r.a or 0, r.b) for r in good.collect()) == [(0, "y"), (1, "x")]
    assert sorted(r.line for r in bad.collect()) == ["not json", '{"a": "wrong"}']


def test_json_in_text(spark):
    rows = spark.createDataFrame([("noise ```json\n{\"a\": 1}\n``` end",), ("x {\"a\": 2} y",), ("nothing",), (None,)], "t string")
    assert [r.j.a if r.j else None for r in rows.select(files.json_in_text(F.col("t"), "a int").alias("j")).collect()] == [1, 2, None, None]


def test_versions_move_together(spark, tmp_path):
    folder = str(tmp_path / "store")
    versions.commit(spark, folder, {"a": spark.range(3), "b": spark.range(1)})
    versions.commit(spark, folder, {"a": versions.current(spark, folder, "a").where("id > 0")})
    assert versions.current(spark, folder, "a").count() == 2 and versions.current(spark, folder, "b").count() == 1
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        versions.commit(spark, folder, {"b": spark.range(9), "a": broken})
    assert versions.current(spark, folder, "a").count() == 2 and versions.current(spark, folder, "b").count() == 1
    with pytest.raises(KeyError):
        versions.current(spark, folder, "c")


def test_stream_of_several_files(spark, tmp_path):
    rows = [(i % 3, f"2025-01-{1 + i // 4:02d} 00:00:00", i, "ab"[i % 2], 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id int, ts string, event_id int, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    for k in range(3):
        df.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = X.stream_table(spark, str(tmp_path), "events", files_per_batch=1)
    latest = {r.user_id: r.event_id for r in X.latest_by_key(stream, "user_id", ["ts", "event_id"], "t").collect()}
    assert latest == {0: 57, 1: 58, 2: 59}
    whole = X.stream_table(spark, str(tmp_path), "events", files_per_batch=9)
    got = X.drain(X.windowed_changes(whole, "ts", "event_type"), "w").collect()
    assert sum(r.n for r in got) == 48 and max(r.start for r in got).day == 12


def test_windows_are_whole_in_any_file_order(spark, tmp_path):
    from docloom.plans import graph

    rows = [(f"2025-01-{1 + i // 4:02d} 00:00:00", "ab"[i % 2], 1.0) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, "a", 1.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    for days in ("ts >= '2025-01-11'", "ts < '2025-01-06' OR ts IS NULL", "ts >= '2025-01-06' AND ts < '2025-01-11'"):
        df.where(days).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    one = X.whole_windows(X.stream_table(spark, str(tmp_path), "events", files_per_batch=1), "ts", "event_type", "w").collect()
    assert len(one) == 30 and {(r.n, r.total) for r in one} == {(2, 2.0)}
    assert sum(r.n for r in graph.stream_windows_all(spark, str(tmp_path)).collect()) == 60
    assert sum(r.n for r in graph.stream_windows(spark, str(tmp_path)).collect()) == 48


def test_late_rows_reach_closed_windows(spark, tmp_path):
    from docloom.plans import graph

    for k in range(18):  # more than two batches: the second batch is still held against the watermark before the first
        spark.sql(f"SELECT TIMESTAMP_NTZ'2025-01-01' + make_dt_interval({(17 - k) * 3}) AS ts, 'a' AS event_type, 1.0D AS value").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert sum(r.n for r in graph.stream_windows(spark, str(tmp_path)).collect()) == 17


def test_maintained_orphans_over_many_batches_of_repeated_rows(spark, tmp_path):
    from docloom.operators import references as R
    from docloom.streaming import changes as X

    refs = [(i, f"s{i % 9}", f"s{i % 13}", dt.datetime(2025, 1, 1 + i % 20)) for i in range(60)]
    lives = [(f"s{k}", dt.datetime(2025, 1, 2), None if k % 2 else dt.datetime(2025, 1, 5)) for k in range(8)] + [(None, None, None), ("s9", None, None)]
    candidates = spark.createDataFrame(refs + refs[:20], "candidate_id long, source_section_id string, target_section_id string, generated_at timestamp")
    sections = spark.createDataFrame(lives + lives[:4], "section_id string, ingested_at timestamp, deleted_at timestamp")
    items = spark.createDataFrame([("c1", None, [("r", "s1"), ("r", None)], ("s3", "gone"), [" ", "s12"])] * 2, "conflict_id string, created_at timestamp, source_refs array<struct<source_ref string, source_section_id string>>, section_pair struct<left_section_id string, right_section_id string>, related_sections array<string>")
    for name, df in (("related_section_candidates", candidates), ("sections", sections), ("conflict_review_items", items)):
        df.repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.ref_id, r.refs) for r in X.maintained_orphans(spark, str(tmp_path), files_per_batch=1).collect()}
    want = R.current_orphans(R.reference_state(R.candidate_references(candidates).unionByName(R.conflict_references(items)), sections))
    assert got == {(r.ref_id, r.refs) for r in want.collect()} and ("gone", 1) in got


def test_a_repeated_batch_changes_nothing_and_buckets_keep_two_slots(spark, tmp_path):
    from docloom.streaming.state import BucketedState

    state = BucketedState(spark, str(tmp_path), "k", "k string, n bigint", buckets=4)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n bigint")
    state.merge(rows(("a", 1), ("b", 1)), 0, add)
    for _ in range(2):
        state.merge(rows(("a", 5), ("c", 2)), 1, add)
    state.merge(rows(), 2, add)
    state.merge(rows(("a", 1)), 3, add)
    assert {(r.k, r.n) for r in state.rows(3).collect()} == {("a", 7), ("b", 1), ("c", 2)}
    assert {(r.k, r.n) for r in state.rows(0).collect()} <= {("a", 1), ("b", 1), ("a", 7)}
    assert all(len(list(b.glob("slot=*"))) <= 2 for b in (tmp_path / "rows").glob("bucket=*"))
