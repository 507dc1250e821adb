"""Queries on candidates and on keyed tables over time, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import candidates as K
from docloom.operators import snapshots as S
from docloom.operators import store as O
from docloom.sources.tables import table

_C = F.col


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return K.merge_channels(table(spark, d, "related_section_candidates"))


def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


def candidate_limit(spark: SparkSession, d: str) -> DataFrame:
    return K.limit_per_source(_merged(spark, d), 3).select("source_section_id", "target_section_id", "place", "score")


def candidate_dropped(spark: SparkSession, d: str) -> DataFrame:
    return K.dropped_report(_merged(spark, d), 3)


def candidate_gate(spark: SparkSession, d: str) -> DataFrame:
    return K.gate(_merged(spark, d), 80.5, 2).select("source_section_id", "target_section_id", "place")


def candidate_limit_32(spark: SparkSession, d: str) -> DataFrame:
    """As candidate_limit, at the limit of the reference (related_candidate_max_per_section)."""
    return K.limit_per_source(_merged(spark, d)).select("source_section_id", "target_section_id", "place", "score")


def candidate_dropped_32(spark: SparkSession, d: str) -> DataFrame:
    return K.dropped_report(_merged(spark, d))


def candidate_gate_8(spark: SparkSession, d: str) -> DataFrame:
    """As candidate_gate, at the reference's section_dense_threshold and section_final_top_n."""
    return K.gate(_merged(spark, d), 0.55, 8).select("source_section_id", "target_section_id", "place")


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.unordered_pairs(table(spark, d, "related_section_candidates"))


def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "related_section_candidates").select("candidate_id", "source", F.explode("channels").alias("channel")).distinct()
    return rows.where("channel IS NOT NULL").groupBy("source", "channel").agg(F.count(F.lit(1)).alias("n"))


def shared_identifier_groups(spark: SparkSession, d: str) -> DataFrame:
    return K.owners(table(spark, d, "work_items"), "section_id", "identifiers")


def shared_identifier_members(spark: SparkSession, d: str) -> DataFrame:
    return K.memberships(table(spark, d, "work_items"), "section_id", "identifiers")


def _snapshot(spark: SparkSession, d: str, last: int) -> DataFrame:
    """The valid rows of the last snapshot (0) or of one before it, with all columns."""
    rows = table(spark, d, "section_snapshots").where("section_id IS NOT NULL")
    number = rows.select("snapshot_no").distinct().orderBy(F.desc("snapshot_no")).limit(last + 1).agg(F.min("snapshot_no").alias("snapshot_no"))
    rows = rows.join(F.broadcast(number), "snapshot_no")
    order = F.struct("delivered_at", F.lower("source_hash").alias("source"), F.lower("semantic_hash").alias("semantic"))
    columns = ["stable_section_uid", "source_document_id", "chapter_id", "heading_path"]
    latest = rows.groupBy("section_id").agg(F.max(order).alias("o"), F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("c"))
    return latest.select("section_id", _C("o.source").alias("source_hash"), _C("o.semantic").alias("semantic_hash"), *[f"c.{c}" for c in columns])


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    columns = ["source_hash", "semantic_hash", "chapter_id", "stable_section_uid", "source_document_id"]
    return O.keyed_diff(_snapshot(spark, d, 1), _snapshot(spark, d, 0), "section_id", columns)


def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot, rebuilt from the one before it and the difference."""
    old, new = _snapshot(spark, d, 1), _snapshot(spark, d, 0)
    diff = O.keyed_diff(old, new, "section_id", ["source_hash", "semantic_hash", "chapter_id", "stable_section_uid", "source_document_id"])
    changed = new.join(diff.where("change <> 'removed'").select("section_id"), "section_id", "left_semi")
    return O.upsert(old, changed, diff.where("change = 'removed'"), "section_id").select("section_id", "source_hash", "semantic_hash", "chapter_id")


def snapshot_patch(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot before the last one with the last one's chapter ids where there are any."""
    return O.patch_column(_snapshot(spark, d, 1).select("section_id", "chapter_id"), _snapshot(spark, d, 0), "section_id", "chapter_id")


def snapshot_renames(spark: SparkSession, d: str) -> DataFrame:
    return O.renames(_snapshot(spark, d, 1), _snapshot(spark, d, 0), "stable_section_uid", "section_id", "semantic_hash")


def index_verify(spark: SparkSession, d: str) -> DataFrame:
    """The last manifest against the sections that are still there."""
    live = table(spark, d, "sections").where("section_id IS NOT NULL AND deleted_at IS NULL").select("section_id", F.lower("source_hash").alias("source_hash"), F.lower("semantic_hash").alias("semantic_hash"), "chapter_id").distinct()
    return O.verify(live, _snapshot(spark, d, 0), "section_id", ["source_hash", "semantic_hash", "chapter_id"])


def document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return O.fingerprint(_snapshot(spark, d, 0), "source_document_id", ["section_id", "source_hash", "semantic_hash"])


def source_drift(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose live sections and last manifest differ, by how; a missing hash says nothing."""
    live = table(spark, d, "sections").where("section_id IS NOT NULL AND deleted_at IS NULL").select("section_id", "source_document_id", "source_hash", "semantic_hash").distinct()
    seen = _snapshot(spark, d, 0).select("section_id", _C("source_document_id").alias("doc"), _C("source_hash").alias("s"), _C("semantic_hash").alias("m"))
    both = live.join(seen, "section_id", "full")
    there = _C("source_document_id").isNotNull() & _C("doc").isNotNull()
    kind = (
        F.when(_C("doc").isNull(), "not_in_manifest").when(_C("source_document_id").isNull(), "not_live")
        .when(there & O.drifted(_C("semantic_hash"), _C("m")), "content").when(there & O.drifted(_C("source_hash"), _C("s")), "format")
    )
    return both.select(F.coalesce("source_document_id", "doc").alias("document"), kind.alias("drift")).where("drift IS NOT NULL").groupBy("document", "drift").agg(F.count(F.lit(1)).alias("sections"))


def changed_bases(spark: SparkSession, d: str) -> DataFrame:
    """Conflict items by how many of their recorded base hashes no longer hold; a missing one counts as changed."""
    items = table(spark, d, "conflict_review_items").select("conflict_id", F.explode("base_source_hashes").alias("b")).where("b.source_ref IS NOT NULL").select("conflict_id", _C("b.source_ref").alias("section_id"), _C("b.hash").alias("hash")).distinct()
    now = table(spark, d, "sections").where("section_id IS NOT NULL AND deleted_at IS NULL").groupBy("section_id").agg(F.min(F.lower("source_hash")).alias("now"))
    checked = items.join(now, "section_id", "left").withColumn("changed", O.base_changed(_C("hash"), _C("now")))
    return checked.groupBy("conflict_id").agg(F.count(F.lit(1)).alias("bases"), F.count_if("changed").alias("changed"))


def affected_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections to look at again: changed ones, and sources of candidates that point to a changed or removed one."""
    diff = S.snapshot_changes(table(spark, d, "section_snapshots"))
    changed = diff.where("change_kind <> 'reformatted'").select("section_id").distinct()
    pointing = table(spark, d, "related_section_candidates").select("source_section_id", _C("target_section_id").alias("section_id")).join(changed, "section_id", "left_semi")
    return changed.unionByName(pointing.where("trim(source_section_id) <> ''").select(_C("source_section_id").alias("section_id"))).distinct()


QUERIES = {
    f.__name__: f
    for f in (candidate_merge, candidate_limit, candidate_dropped, candidate_gate, candidate_limit_32, candidate_dropped_32, candidate_gate_8, candidate_pairs, channel_counts, shared_identifier_groups, shared_identifier_members, snapshot_diff, snapshot_upsert, snapshot_patch, snapshot_renames, index_verify, document_fingerprints, source_drift, changed_bases, affected_sections)
}

_W = "CASE v WHEN 'markdown_link' THEN 100.0 WHEN 'shared_identifier' THEN 90.0 WHEN 'search_key_match' THEN 80.0 WHEN 'qdrant_section_hybrid' THEN 60.0 ELSE 0.0 END"
_MERGED = f"""WITH p AS (SELECT * FROM related_section_candidates WHERE trim(source_section_id, ' ') <> '' AND trim(target_section_id, ' ') <> '' AND source_section_id <> target_section_id),
ch AS (SELECT DISTINCT source_section_id AS a, target_section_id AS b, v FROM (SELECT source_section_id, target_section_id, unnest(channels) AS v FROM p) WHERE v IS NOT NULL),
tm AS (SELECT source_section_id AS a, target_section_id AS b, count(DISTINCT v) AS n FROM (SELECT source_section_id, target_section_id, unnest(evidence_terms) AS v FROM p) WHERE trim(v, ' ') <> '' GROUP BY ALL),
cm AS (SELECT a, b, list_sort(list(v)) AS channels, max({_W}) AS best, count(*) AS n, bool_or(v IN ('markdown_link', 'shared_identifier')) AS exact FROM ch GROUP BY a, b),
m AS (SELECT DISTINCT source_section_id, target_section_id, coalesce(cm.channels, []) AS channels, coalesce(tm.n, 0) AS n_terms, coalesce(exact, false) AS exact, CAST(coalesce(best, 0.0) AS DOUBLE) AS best,
  round(CAST(coalesce(best, 0.0) AS DOUBLE) + least(5.0, greatest(0.0, coalesce(cm.n, 0) - 1.0)) + least(3.0, coalesce(tm.n, 0) * 0.25), 6) AS score
  FROM p LEFT JOIN cm ON cm.a = source_section_id AND cm.b = target_section_id LEFT JOIN tm ON tm.a = source_section_id AND tm.b = target_section_id)"""
_OWN = "o AS (SELECT DISTINCT section_id AS owner, trim(v, ' ') AS value FROM (SELECT section_id, unnest(identifiers) AS v FROM work_items) WHERE section_id IS NOT NULL AND trim(v, ' ') <> ''), g AS (SELECT value, count(*) AS owners, min(owner) AS first_owner FROM o GROUP BY value HAVING count(*) >= 2)"
_SNAP = """WITH no AS (SELECT snapshot_no, row_number() OVER (ORDER BY snapshot_no DESC) AS back FROM (SELECT DISTINCT snapshot_no FROM section_snapshots WHERE section_id IS NOT NULL)),
ranked AS (SELECT s.*, back, row_number() OVER (PARTITION BY section_id, snapshot_no ORDER BY delivered_at DESC NULLS LAST, lower(source_hash) DESC NULLS LAST, lower(semantic_hash) DESC NULLS LAST, stable_section_uid DESC NULLS LAST, source_document_id DESC NULLS LAST, chapter_id DESC NULLS LAST) AS rn FROM section_snapshots s JOIN no USING (snapshot_no) WHERE section_id IS NOT NULL AND back <= 2),
snap AS (SELECT back, section_id, lower(source_hash) AS source_hash, lower(semantic_hash) AS semantic_hash, chapter_id, stable_section_uid, source_document_id FROM ranked WHERE rn = 1),
a AS (SELECT * FROM snap WHERE back = 2), b AS (SELECT * FROM snap WHERE back = 1)"""
_LIVE = "SELECT DISTINCT section_id, source_document_id, lower(source_hash) AS source_hash, lower(semantic_hash) AS semantic_hash, chapter_id FROM sections WHERE section_id IS NOT NULL AND deleted_at IS NULL"
_FIRST = "CASE " + " ".join(f"WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}'" for c in ("source_hash", "semantic_hash", "chapter_id", "stable_section_uid", "source_document_id")) + " END"
_STRONG = "row_number() OVER (PARTITION BY source_section_id ORDER BY exact DESC, best DESC, score DESC, list_contains(channels, 'qdrant_section_hybrid') DESC, target_section_id)"


def _changes_sql() -> str:
    from docloom.plans.dealt import _SNAPSHOTS

    return _SNAPSHOTS


SQL = {
    "candidate_merge": f"{_MERGED} SELECT * FROM m",
    "candidate_limit": f"{_MERGED} SELECT source_section_id, target_section_id, place, score FROM (SELECT *, {_STRONG} AS place FROM m) WHERE place <= 3",
    "candidate_dropped": f"{_MERGED} SELECT source_section_id, CAST(3 AS BIGINT) AS kept, count(*) - 3 AS dropped FROM m GROUP BY 1 HAVING count(*) > 3",
    "candidate_gate": f"{_MERGED} SELECT source_section_id, target_section_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source_section_id ORDER BY score DESC, target_section_id) AS place FROM m WHERE score >= 80.5 OR exact) WHERE place <= 2 OR exact",
    "candidate_limit_32": f"{_MERGED} SELECT source_section_id, target_section_id, place, score FROM (SELECT *, {_STRONG} AS place FROM m) WHERE place <= 32",
    "candidate_dropped_32": f"{_MERGED} SELECT source_section_id, CAST(32 AS BIGINT) AS kept, count(*) - 32 AS dropped FROM m GROUP BY 1 HAVING count(*) > 32",
    "candidate_gate_8": f"{_MERGED} SELECT source_section_id, target_section_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source_section_id ORDER BY score DESC, target_section_id) AS place FROM m WHERE score >= 0.55 OR exact) WHERE place <= 8 OR exact",
    "candidate_pairs": """WITH r AS (SELECT least(source_section_id, target_section_id) AS left_id, greatest(source_section_id, target_section_id) AS right_id, source_section_id < target_section_id AS forward FROM related_section_candidates WHERE trim(source_section_id, ' ') <> '' AND trim(target_section_id, ' ') <> '')
SELECT left_id, right_id, 'section_pair:sha256:v1:' || sha256('["v1",["' || replace(replace(left_id, '\\', '\\\\'), '"', '\\"') || '","' || replace(replace(right_id, '\\', '\\\\'), '"', '\\"') || '"]]') AS pair_id, count(DISTINCT forward) AS directions FROM r GROUP BY left_id, right_id""",
    "channel_counts": "SELECT source, channel, count(*) AS n FROM (SELECT DISTINCT candidate_id, source, unnest(channels) AS channel FROM related_section_candidates) WHERE channel IS NOT NULL GROUP BY ALL",
    "shared_identifier_groups": f"WITH {_OWN} SELECT * FROM g",
    "shared_identifier_members": f"WITH {_OWN} SELECT owner, o.value, owners FROM o JOIN g ON g.value = o.value",
    "snapshot_diff": f"""{_SNAP} SELECT coalesce(a.section_id, b.section_id) AS section_id, CASE WHEN a.section_id IS NULL THEN 'added' WHEN b.section_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN a.section_id IS NOT NULL AND b.section_id IS NOT NULL THEN {_FIRST} END AS first_column FROM a FULL JOIN b ON a.section_id = b.section_id WHERE a.section_id IS NULL OR b.section_id IS NULL OR {_FIRST} IS NOT NULL""",
    "snapshot_upsert": f"{_SNAP} SELECT section_id, source_hash, semantic_hash, chapter_id FROM b",
    "snapshot_patch": f"{_SNAP} SELECT a.section_id, coalesce(b.chapter_id, a.chapter_id) AS chapter_id FROM a LEFT JOIN b ON a.section_id = b.section_id",
    "snapshot_renames": f"""{_SNAP}, x AS (SELECT stable_section_uid AS u, min(section_id) AS k, min(semantic_hash) AS h FROM a WHERE stable_section_uid IS NOT NULL GROUP BY 1 HAVING count(*) = 1), y AS (SELECT stable_section_uid AS u, min(section_id) AS k, min(semantic_hash) AS h FROM b WHERE stable_section_uid IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
SELECT u AS stable_section_uid, x.k AS old_key, y.k AS new_key, CASE WHEN x.k <> y.k AND coalesce(x.h <> y.h, false) THEN 'renamed_and_edited' WHEN x.k <> y.k THEN 'renamed' ELSE 'edited' END AS kind FROM x JOIN y USING (u) WHERE x.k <> y.k OR coalesce(x.h <> y.h, false)""",
    "index_verify": f"""{_SNAP}, l AS ({_LIVE}), d AS (SELECT coalesce(l.section_id, b.section_id) AS section_id, CASE WHEN b.section_id IS NULL THEN 'missing' WHEN l.section_id IS NULL THEN 'stale' END AS i,
list_filter([{", ".join(f"CASE WHEN l.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in ("source_hash", "semantic_hash", "chapter_id"))}], lambda e: e IS NOT NULL) AS f FROM l FULL JOIN b ON l.section_id = b.section_id)
SELECT section_id, coalesce(i, 'mismatch') AS issue, CASE WHEN i IS NULL THEN f ELSE [] END AS fields FROM d WHERE i IS NOT NULL OR len(f) > 0""",
    "document_fingerprints": f"""{_SNAP}, h AS (SELECT source_document_id, sha256(concat_ws('|', coalesce(section_id, ''), coalesce(source_hash, ''), coalesce(semantic_hash, ''))) AS h FROM b)
SELECT source_document_id, count(*) AS rows, sha256(concat_ws(':', count(*), {", ".join(f"sum(CAST('0x' || substring(h, {1 + 12 * i}, 12) AS BIGINT))" for i in range(4))})) AS fingerprint FROM h GROUP BY 1""",
    "source_drift": f"""{_SNAP}, l AS (SELECT DISTINCT section_id, source_document_id, source_hash, semantic_hash FROM ({_LIVE})), j AS (SELECT l.source_document_id AS ld, b.source_document_id AS bd,
CASE WHEN b.source_document_id IS NULL THEN 'not_in_manifest' WHEN l.source_document_id IS NULL THEN 'not_live' WHEN coalesce(l.semantic_hash <> b.semantic_hash, false) THEN 'content' WHEN coalesce(l.source_hash <> b.source_hash, false) THEN 'format' END AS drift FROM l FULL JOIN b ON l.section_id = b.section_id)
SELECT coalesce(ld, bd) AS document, drift, count(*) AS sections FROM j WHERE drift IS NOT NULL GROUP BY ALL""",
    "changed_bases": """WITH i AS (SELECT DISTINCT conflict_id, b.source_ref AS section_id, b.hash AS hash FROM (SELECT conflict_id, unnest(base_source_hashes) AS b FROM conflict_review_items) WHERE b.source_ref IS NOT NULL),
n AS (SELECT section_id, min(lower(source_hash)) AS now FROM sections WHERE section_id IS NOT NULL AND deleted_at IS NULL GROUP BY 1)
SELECT conflict_id, count(*) AS bases, count(*) FILTER (NOT coalesce(lower(hash) = now, false)) AS changed FROM i LEFT JOIN n USING (section_id) GROUP BY 1""",
    "affected_sections": f"""{_changes_sql()}, ch AS (SELECT DISTINCT section_id FROM events WHERE change_kind <> 'reformatted')
SELECT section_id FROM ch UNION SELECT source_section_id FROM related_section_candidates WHERE trim(source_section_id, ' ') <> '' AND target_section_id IN (SELECT section_id FROM ch)""",
}
