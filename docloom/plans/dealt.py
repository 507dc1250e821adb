"""Queries of the general problems 1 and 2, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import references as R
from docloom.operators import snapshots as S
from docloom.sources.tables import table
from docloom.streaming import changes as X


def _references(spark: SparkSession, d: str) -> DataFrame:
    return R.candidate_references(table(spark, d, "related_section_candidates")).unionByName(R.conflict_references(table(spark, d, "conflict_review_items")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_references(_references(spark, d), table(spark, d, "sections")).select("ref_table", "record_id", "ref_field", "ref_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(R.orphan_references(_references(spark, d), table(spark, d, "sections")))


def p1_current(spark: SparkSession, d: str) -> DataFrame:
    return R.current_orphans(R.reference_state(_references(spark, d), table(spark, d, "sections")))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """As ``p1_current``, from counts maintained by change deltas over streams of the tables."""
    return X.maintained_orphans(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return S.snapshot_changes(table(spark, d, "section_snapshots"))


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    return S.validity_intervals(table(spark, d, "section_snapshots")).select(F.col("key").alias("section_id"), "first_no", "last_no", "opened_by", "gone_at")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.snapshot_changes(table(spark, d, "section_snapshots")).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n"))


_REFS = r"""
refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'related_section_candidates' AS ref_table, CAST(candidate_id AS VARCHAR) AS record_id, 'source_section_id' AS ref_field, source_section_id AS ref_id, generated_at AS t FROM related_section_candidates
    UNION ALL SELECT 'related_section_candidates', CAST(candidate_id AS VARCHAR), 'target_section_id', target_section_id, generated_at FROM related_section_candidates
    UNION ALL SELECT 'conflict_review_items', conflict_id, 'left_section_id', section_pair.left_section_id, created_at FROM conflict_review_items
    UNION ALL SELECT 'conflict_review_items', conflict_id, 'right_section_id', section_pair.right_section_id, created_at FROM conflict_review_items
    UNION ALL SELECT 'conflict_review_items', conflict_id, 'source_refs', s.source_section_id, created_at FROM (SELECT conflict_id, created_at, unnest(source_refs) AS s FROM conflict_review_items)
    UNION ALL SELECT 'conflict_review_items', conflict_id, 'related_sections', s, created_at FROM (SELECT conflict_id, created_at, unnest(related_sections) AS s FROM conflict_review_items)
  ) WHERE ref_id IS NOT NULL AND NOT regexp_full_match(ref_id, '[\s\x{00A0}\x{3000}]*')
)"""
_ORPHANS = f"""WITH {_REFS},
orphans AS (
  SELECT * FROM refs r WHERE
    (t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.section_id = r.ref_id AND s.ingested_at <= r.t AND (s.deleted_at IS NULL OR s.deleted_at > r.t)))
    OR (t IS NULL AND NOT EXISTS (SELECT 1 FROM sections s WHERE s.section_id = r.ref_id))
)"""
_SNAPSHOTS = """WITH rows_ AS (
  SELECT snapshot_no AS no, section_id, lower(source_hash) AS a, lower(semantic_hash) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY section_id, snapshot_no ORDER BY delivered_at DESC NULLS LAST, lower(source_hash) DESC NULLS LAST, lower(semantic_hash) DESC NULLS LAST) AS rn
    FROM section_snapshots WHERE section_id IS NOT NULL AND snapshot_no IS NOT NULL) WHERE rn = 1),
numbers AS (SELECT no, lag(no) OVER (ORDER BY no) AS before FROM (SELECT DISTINCT no FROM rows_)),
cur AS (SELECT r.*, n.before FROM rows_ r JOIN numbers n USING (no)),
pairs AS (
  SELECT c.no, c.section_id, CASE
      WHEN p.section_id IS NULL THEN 'added'
      WHEN c.b IS NOT NULL AND p.b IS NOT NULL THEN CASE WHEN c.b <> p.b THEN 'changed' WHEN c.a <> p.a THEN 'reformatted' END
      WHEN c.a <> p.a THEN 'changed' END AS change_kind
  FROM cur c LEFT JOIN rows_ p ON p.section_id = c.section_id AND p.no = c.before),
events AS (
  SELECT no AS snapshot_no, section_id, change_kind FROM pairs WHERE change_kind IS NOT NULL AND no > (SELECT min(no) FROM rows_)
  UNION ALL
  SELECT n.no, p.section_id, 'removed' FROM rows_ p JOIN numbers n ON n.before = p.no
  WHERE NOT EXISTS (SELECT 1 FROM rows_ c WHERE c.no = n.no AND c.section_id = p.section_id)
)"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_current": p1_current, "p1_incremental": p1_incremental, "p2_found": p2_found, "p2_intervals": p2_intervals, "p2_counts": p2_counts}

SQL = {
    "p1_found": f"{_ORPHANS} SELECT DISTINCT ref_table, record_id, ref_field, ref_id FROM orphans",
    "p1_report": f"{_ORPHANS} SELECT ref_table, ref_field, date_trunc('month', t) AS period, count(*) AS orphans, count(DISTINCT record_id) AS records, count(DISTINCT ref_id) AS ids FROM orphans GROUP BY ALL",
    "p1_current": f"""WITH {_REFS},
lives AS (SELECT DISTINCT section_id, ingested_at, deleted_at FROM sections WHERE ingested_at IS NOT NULL)
SELECT ref_id, count(*) AS refs FROM refs r WHERE NOT EXISTS (SELECT 1 FROM lives s WHERE s.section_id = r.ref_id AND s.deleted_at IS NULL) GROUP BY ref_id""",
    "p2_found": f"{_SNAPSHOTS} SELECT snapshot_no, section_id, change_kind FROM events",
    "p2_intervals": f"""{_SNAPSHOTS},
marked AS (SELECT no, section_id, change_kind, sum(CASE WHEN change_kind IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY section_id ORDER BY no) AS island FROM pairs),
islands AS (SELECT section_id, min(no) AS first_no, max(no) AS last_no, max(change_kind) AS opened_by FROM marked GROUP BY section_id, island)
SELECT i.section_id, first_no, last_no, opened_by, e.snapshot_no AS gone_at
FROM islands i LEFT JOIN numbers n ON n.before = i.last_no LEFT JOIN events e ON e.change_kind = 'removed' AND e.section_id = i.section_id AND e.snapshot_no = n.no""",
    "p2_counts": f"{_SNAPSHOTS} SELECT snapshot_no, change_kind, count(*) AS n FROM events GROUP BY ALL",
}
SQL["p1_incremental"] = SQL["p1_current"]
