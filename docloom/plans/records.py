"""Queries on section payloads, pair candidates under a cap, and what has to be rebuilt, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import candidates as K
from docloom.operators import store as O
from docloom.plans.corpus import _SNAP, _snapshot, candidate_pairs, changed_bases
from docloom.plans.text import _HEAD_LINE, _KEYS, _SQL_SECTIONS, _SUMMARY, _sections
from docloom.sources.tables import table

_C = F.col


def _described(spark: SparkSession, d: str) -> DataFrame:
    """Sections with summary, search keys and identifiers."""
    items = table(spark, d, "work_items").where("section_id IS NOT NULL").select("section_id", "identifiers").distinct()
    rows = _sections(spark, d).join(items, "section_id", "left")
    return rows.withColumns({"summary": T.fallback_summary(_C("heading_path"), _C("text")), "search_keys": T.search_keys(_C("heading_path"), _C("identifiers"))})


def section_payload(spark: SparkSession, d: str) -> DataFrame:
    """What is stored for a section beside its vectors; missing lists are empty, a missing semantic hash is the source hash."""
    ids = table(spark, d, "sections").where("section_id IS NOT NULL").select("section_id", "stable_section_uid", "source_hash", "semantic_hash", _C("source_span.start_line").alias("start_line"), _C("source_span.end_line").alias("end_line")).distinct()
    none = F.array().cast("array<string>")
    text = T.embedding_text(_C("heading_path"), _C("summary"), _C("search_keys"), _C("identifiers"))
    rows = _described(spark, d).withColumn("text", text).join(ids, "section_id")
    uid = F.coalesce("stable_section_uid", "section_id")
    return rows.select(
        _C("section_id").alias("source_section_id"), F.coalesce("source_document_id", F.lit("")).alias("source_document_id"), uid.alias("stable_section_uid"), uid.alias("stable_chunk_uid"), F.coalesce("heading_path", none).alias("heading_path"),
        "start_line", "end_line", F.coalesce("source_hash", F.lit("")).alias("source_hash"), F.coalesce("semantic_hash", "source_hash", F.lit("")).alias("semantic_hash"), "summary", "search_keys", F.coalesce("identifiers", none).alias("identifiers"), "text",
    )


def section_query_text(spark: SparkSession, d: str) -> DataFrame:
    """The text a section is searched with: heading, summary and keys, or its raw text where it has none of them."""
    return _described(spark, d).select("section_id", T.query_text(_C("heading_path"), _C("summary"), _C("search_keys"), _C("text")).alias("query_text"))


def section_body_text(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("section_id", T.has_body_text(_C("text")).alias("has_body"))


def _pairs(spark: SparkSession, d: str, cap: int) -> DataFrame:
    live = table(spark, d, "sections").where("section_id IS NOT NULL AND deleted_at IS NULL").select("section_id").distinct()
    items = table(spark, d, "conflict_review_items").select("conflict_id", _C("section_pair.left_section_id").alias("left_id"), _C("section_pair.right_section_id").alias("right_id")).where("trim(left_id) <> '' AND trim(right_id) <> ''").distinct()
    changed = items.join(changed_bases(spark, d).where("changed > 0"), "conflict_id", "left_semi")
    for side in ("left_id", "right_id"):
        changed = changed.join(live.withColumnRenamed("section_id", side), side, "left_semi")
    selves = live.select(_C("section_id").alias("left_id"), _C("section_id").alias("right_id"))
    found = candidate_pairs(spark, d).where("left_id <> right_id")
    return K.capped_union(found.select("left_id", "right_id", F.lit("section_pair_retrieval").alias("origin")), [(selves, "all_pairs"), (changed, "existing_conflict_recheck")], cap)


def section_pairs_80(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved pairs under the global cap of 80, with all pairs of a section with itself and all rechecks."""
    return _pairs(spark, d, 80)


def section_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same without a cap."""
    return _pairs(spark, d, -1)


def document_modes(spark: SparkSession, d: str) -> DataFrame:
    """What the last snapshot asks of every document: skip, partial (hashes of the same sections differ), full, or gone."""
    def state(last: int, name: str) -> DataFrame:
        rows = _snapshot(spark, d, last).where("source_document_id IS NOT NULL")
        ids = O.fingerprint(rows, "source_document_id", ["section_id"]).select("source_document_id", _C("fingerprint").alias(f"{name}_ids"))
        hashes = O.fingerprint(rows, "source_document_id", ["section_id", "source_hash", "semantic_hash"]).select("source_document_id", _C("fingerprint").alias(f"{name}_state"))
        return ids.join(hashes, "source_document_id")

    both = state(1, "old").join(state(0, "new"), "source_document_id", "full")
    mode = F.when(_C("new_ids").isNull(), "gone").when(_C("old_state") == _C("new_state"), "skip").when(_C("old_ids") == _C("new_ids"), "partial").otherwise("full")
    return both.select("source_document_id", mode.alias("mode"))


def relations_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the allowed channels with a score of at least 0.5; a missing score is too low."""
    rows = table(spark, d, "related_section_candidates").where("candidate_id IS NOT NULL").select("candidate_id", F.array_intersect("channels", F.array(F.lit("markdown_link"), F.lit("shared_identifier"))).alias("channels"), _C("candidate_score").alias("score")).distinct()
    return rows.where("size(channels) > 0 AND score >= 0.5").select("candidate_id", F.array_sort("channels").alias("channels"))


def relation_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Exact candidates of every source; the others only where a source has no exact one."""
    rows = table(spark, d, "related_section_candidates").where("trim(source_section_id) <> '' AND trim(target_section_id) <> ''")
    exact = F.coalesce(F.arrays_overlap("channels", F.array(F.lit("markdown_link"), F.lit("shared_identifier"))), F.lit(False))
    pairs = rows.groupBy("source_section_id", "target_section_id").agg(F.bool_or(exact).alias("exact"))
    return K.with_fallback(pairs.where("exact"), pairs.where("NOT exact"), "source_section_id").select("source_section_id", "target_section_id", "origin")


QUERIES = {f.__name__: f for f in (section_payload, section_query_text, section_body_text, section_pairs_80, section_pairs, document_modes, relations_allowed, relation_fallback)}

_DESCRIBED = f"""{_SQL_SECTIONS}, {_KEYS},
sums AS (SELECT section_id, heading_path, text, {_SUMMARY} AS summary FROM ({_HEAD_LINE})),
des AS (SELECT k.section_id, k.heading_path, k.text, k.identifiers, k.search_keys, m.summary FROM keys k JOIN (SELECT DISTINCT section_id, summary FROM sums) m USING (section_id))"""
_PAIRS = """WITH live AS (SELECT DISTINCT section_id FROM sections WHERE section_id IS NOT NULL AND deleted_at IS NULL),
got AS (SELECT DISTINCT least(source_section_id, target_section_id) AS left_id, greatest(source_section_id, target_section_id) AS right_id FROM related_section_candidates WHERE trim(source_section_id, ' ') <> '' AND trim(target_section_id, ' ') <> '' AND source_section_id <> target_section_id),
base AS (SELECT DISTINCT conflict_id, b.source_ref AS section_id, b.hash AS hash FROM (SELECT conflict_id, unnest(base_source_hashes) AS b FROM conflict_review_items) WHERE b.source_ref IS NOT NULL),
now AS (SELECT section_id, min(lower(source_hash)) AS now FROM sections WHERE section_id IS NOT NULL AND deleted_at IS NULL GROUP BY 1),
ch AS (SELECT DISTINCT conflict_id FROM base LEFT JOIN now USING (section_id) WHERE NOT coalesce(lower(hash) = now, false)),
re AS (SELECT DISTINCT section_pair.left_section_id AS l, section_pair.right_section_id AS r FROM conflict_review_items WHERE conflict_id IN (SELECT conflict_id FROM ch) AND trim(section_pair.left_section_id, ' ') <> '' AND trim(section_pair.right_section_id, ' ') <> ''),
named AS (
  SELECT left_id, right_id, 'section_pair_retrieval' AS origin, 1 AS p FROM got UNION ALL SELECT section_id, section_id, 'all_pairs', 0 FROM live
  UNION ALL SELECT least(l, r), greatest(l, r), 'existing_conflict_recheck', 2 FROM re WHERE l IN (SELECT section_id FROM live) AND r IN (SELECT section_id FROM live)),
hashed AS (SELECT *, 'section_pair:sha256:v1:' || sha256('["v1",["' || replace(replace(left_id, '\\', '\\\\'), '"', '\\"') || '","' || replace(replace(right_id, '\\', '\\\\'), '"', '\\"') || '"]]') AS pair_id FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY pair_id) AS place FROM hashed)
SELECT left_id, right_id, pair_id, arg_max(origin, p) AS origin FROM ranked WHERE {cap} GROUP BY ALL"""

SQL = {
    "section_payload": f"""WITH {_DESCRIBED}, ids AS (SELECT DISTINCT section_id, stable_section_uid, source_hash, semantic_hash, source_span.start_line AS start_line, source_span.end_line AS end_line, source_document_id FROM sections WHERE section_id IS NOT NULL)
SELECT section_id AS source_section_id, coalesce(source_document_id, '') AS source_document_id, coalesce(stable_section_uid, section_id) AS stable_section_uid, coalesce(stable_section_uid, section_id) AS stable_chunk_uid, coalesce(heading_path, []) AS heading_path, start_line, end_line,
  coalesce(source_hash, '') AS source_hash, coalesce(semantic_hash, source_hash, '') AS semantic_hash, summary, search_keys, coalesce(identifiers, []) AS identifiers,
  array_to_string(list_filter([array_to_string(coalesce(heading_path, []), ' / '), summary, array_to_string(search_keys[1:8], ', '), array_to_string(coalesce(identifiers, [])[1:8], ', ')], lambda e: e IS NOT NULL AND e <> ''), ' | ') AS text FROM des JOIN ids USING (section_id)""",
    "section_query_text": f"""WITH {_DESCRIBED}, q AS (SELECT section_id, text, array_to_string(list_filter([array_to_string(list_filter(coalesce(heading_path, []), lambda e: e <> ''), ' / '), summary, array_to_string(search_keys, ' ')], lambda e: e IS NOT NULL AND e <> ''), ' | ') AS x FROM des)
SELECT section_id, CASE WHEN x <> '' THEN x ELSE coalesce(text, '') END AS query_text FROM q""",
    "section_body_text": f"""WITH {_SQL_SECTIONS} SELECT section_id, len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[\\n\\r]'), lambda e: ltrim(regexp_replace(e, '[\\t\\x0B\\f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ')), lambda e: e <> '' AND e[1] <> '#')) > 0 AS has_body FROM s""",
    "section_pairs_80": _PAIRS.replace("{cap}", "origin <> 'section_pair_retrieval' OR place <= 80"),
    "section_pairs": _PAIRS.replace("{cap}", "true"),
    "document_modes": f"""{_SNAP}, o AS (SELECT source_document_id, list_sort(list(section_id)) AS ids, list_sort(list(concat_ws('|', section_id, coalesce(source_hash, ''), coalesce(semantic_hash, '')))) AS st FROM a WHERE source_document_id IS NOT NULL GROUP BY 1),
n AS (SELECT source_document_id, list_sort(list(section_id)) AS ids, list_sort(list(concat_ws('|', section_id, coalesce(source_hash, ''), coalesce(semantic_hash, '')))) AS st FROM b WHERE source_document_id IS NOT NULL GROUP BY 1)
SELECT coalesce(o.source_document_id, n.source_document_id) AS source_document_id, CASE WHEN n.ids IS NULL THEN 'gone' WHEN o.st = n.st THEN 'skip' WHEN o.ids = n.ids THEN 'partial' ELSE 'full' END AS mode FROM o FULL JOIN n ON o.source_document_id = n.source_document_id""",
    "relations_allowed": """SELECT DISTINCT candidate_id, list_sort(list_filter(['markdown_link', 'shared_identifier'], lambda e: list_contains(channels, e))) AS channels FROM related_section_candidates
WHERE candidate_id IS NOT NULL AND (list_contains(channels, 'markdown_link') OR list_contains(channels, 'shared_identifier')) AND candidate_score >= 0.5""",
    "relation_fallback": """WITH p AS (SELECT source_section_id, target_section_id, bool_or(coalesce(list_contains(channels, 'markdown_link') OR list_contains(channels, 'shared_identifier'), false)) AS exact
  FROM related_section_candidates WHERE trim(source_section_id, ' ') <> '' AND trim(target_section_id, ' ') <> '' GROUP BY 1, 2),
q AS (SELECT *, bool_or(exact) OVER (PARTITION BY source_section_id) AS has_exact FROM p) SELECT source_section_id, target_section_id, CASE WHEN exact THEN 'selected' ELSE 'fallback' END AS origin FROM q WHERE exact OR NOT has_exact""",
}
