"""Queries that generate candidates: links resolved to sections, and channels united, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import candidates as K
from docloom.operators import markdown as M
from docloom.plans.search import _HYBRID, _RANK, section_dense_gate
from docloom.plans.text import _slug
from docloom.sources.tables import table

_C = F.col


def _linked_texts(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, source_id, document_id, text): candidates written as Markdown.

    No text of the tables has links, so every candidate becomes a text that
    links from its source to its target in one of three ways, next to an image,
    an address and a link to the source itself.
    """
    whole = r"^[^\s#]+#[^\s#]+$"
    rows = table(spark, d, "related_section_candidates").select("candidate_id", _C("source_section_id").alias("source"), _C("target_section_id").alias("target")).where(_C("source").rlike(whole) & _C("target").rlike(whole)).distinct()
    document, up = F.substring_index("source", "#", 1), F.repeat(F.lit("../"), F.size(F.split("source", "/")) - 1)
    way = _C("candidate_id") % 3
    url = F.when(way == 0, F.concat(up, F.substring_index("target", "#", 1))).when(way == 1, F.concat(F.lit("/"), "target")).otherwise(F.concat(up, F.lit("./"), "target"))
    text = F.concat(F.lit("![figure](a.png) see [part]("), url, F.lit(')[site](https://example.org/a#b) or [top](#'), F.substring_index("source", "#", -1), F.lit(' "Top").'))
    return rows.select("candidate_id", _C("source").alias("source_id"), document.alias("document_id"), text.alias("text"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    texts = _linked_texts(spark, d).withColumn("key", F.struct("candidate_id", "source_id", "document_id"))
    found = M.links(texts, "key", "text").select(_C("key.candidate_id").alias("source_id"), _C("key.source_id").alias("section_id"), _C("key.document_id").alias("document_id"), "position", "label", "target")
    sections = table(spark, d, "sections").select("section_id", _C("source_document_id").alias("document_id"), _C("source_span.start_line").alias("ordinal"), F.try_element_at("heading_path", F.lit(-1)).alias("heading")).distinct()
    named = M.resolve_links(found, sections).withColumnRenamed("source_id", "candidate_id")
    return named.join(texts.select("candidate_id", _C("source_id").alias("section_id")), "candidate_id")


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("candidate_id", "position", "label", "target_id")


def candidate_generation(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the link and hybrid channels, united per pair and limited per source.

    Sections that share identifiers or keys stay factored (``shared_identifier_members``).
    """
    links = _resolved(spark, d).select(_C("section_id").alias("source_section_id"), _C("target_id").alias("target_section_id"), F.array(F.lit("markdown_link")).alias("channels"))
    of = table(spark, d, "section_vectors").select("stable_chunk_uid", "source_section_id").where("stable_chunk_uid IS NOT NULL AND source_section_id IS NOT NULL").distinct()
    hits = section_dense_gate(spark, d).select("query_id", "row_id")
    named = hits.join(of.select(_C("stable_chunk_uid").alias("query_id"), "source_section_id"), "query_id").join(of.select(_C("stable_chunk_uid").alias("row_id"), _C("source_section_id").alias("target_section_id")), "row_id")
    hybrid = named.select("source_section_id", "target_section_id", F.array(F.lit("qdrant_section_hybrid")).alias("channels"))
    both = links.unionByName(hybrid).withColumn("evidence_terms", F.array().cast("array<string>"))
    return K.limit_per_source(K.merge_channels(both)).select("source_section_id", "target_section_id", "channels", "score", "place")


QUERIES = {f.__name__: f for f in (link_targets, candidate_generation)}

# what each derived link must lead to follows from the candidate it was made of
_LINKS = rf"""c AS (SELECT DISTINCT candidate_id, source_section_id AS source, target_section_id AS target FROM related_section_candidates
  WHERE regexp_full_match(source_section_id, '[^\s#]+#[^\s#]+') AND regexp_full_match(target_section_id, '[^\s#]+#[^\s#]+')),
ids AS (SELECT DISTINCT section_id FROM sections WHERE section_id IS NOT NULL AND source_document_id IS NOT NULL),
firsts AS (SELECT source_document_id AS document, arg_min(section_id, (source_span.start_line, section_id)) AS section_id FROM sections WHERE section_id IS NOT NULL GROUP BY 1),
slugs AS (SELECT source_document_id AS document, {_slug("heading_path[-1]")} AS slug, arg_max(section_id, (source_span.start_line, section_id)) AS section_id FROM sections WHERE section_id IS NOT NULL AND len(heading_path) > 0 GROUP BY 1, 2),
ends AS (SELECT id, coalesce(ids.section_id, slugs.section_id) AS section_id FROM (SELECT source AS id FROM c UNION SELECT ltrim(target, '/') FROM c)
  LEFT JOIN ids ON ids.section_id = id LEFT JOIN slugs ON slugs.document = split_part(id, '#', 1) AND slugs.slug = {_slug("split_part(id, '#', 2)")}),
l AS (
  SELECT candidate_id, source, 0 AS position, 'part' AS label, CASE WHEN candidate_id % 3 = 0 THEN firsts.section_id WHEN candidate_id % 3 = 2 OR target[1] <> '/' THEN ends.section_id END AS target_id FROM c JOIN ends ON ends.id = ltrim(target, '/') LEFT JOIN firsts ON document = split_part(ltrim(target, '/'), '#', 1)
  UNION ALL SELECT candidate_id, source, 1, 'site', NULL FROM c
  UNION ALL SELECT candidate_id, source, 2, 'top', ends.section_id FROM c JOIN ends ON ends.id = source)"""

SQL = {
    "link_targets": f"WITH {_LINKS} SELECT candidate_id, position, label, target_id FROM l",
    "candidate_generation": f"""{_HYBRID}, {_LINKS}, gate AS (SELECT query_id, row_id FROM (SELECT query_id, row_id, {_RANK} AS rank FROM hy WHERE query_id <> row_id AND (dense_score IS NULL OR dense_score >= 0.55)) WHERE rank <= 8),
owner AS (SELECT DISTINCT stable_chunk_uid AS uid, source_section_id AS section_id FROM section_vectors WHERE stable_chunk_uid IS NOT NULL AND source_section_id IS NOT NULL),
found AS (SELECT source AS a, target_id AS b, 'markdown_link' AS channel FROM l UNION SELECT x.section_id, y.section_id, 'qdrant_section_hybrid' FROM gate JOIN owner x ON x.uid = query_id JOIN owner y ON y.uid = row_id),
m AS (SELECT a, b, list_sort(list(channel)) AS channels, CASE WHEN bool_or(channel = 'markdown_link') THEN 100.0 ELSE 60.0 END + count(*) - 1 AS score, bool_or(channel = 'markdown_link') AS link, bool_or(channel = 'qdrant_section_hybrid') AS hybrid
  FROM found WHERE trim(a, ' ') <> '' AND trim(b, ' ') <> '' AND a <> b GROUP BY a, b)
SELECT * FROM (SELECT a AS source_section_id, b AS target_section_id, channels, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY a ORDER BY link DESC, score DESC, hybrid DESC, b) AS place FROM m) WHERE place <= 32""",
}
