"""Queries of the problems on training text and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, leaks, neighbours, pieces, sentences, terms
from docloom.sources.tables import table


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.corpus_terms(table(spark, d, "sections"), table(spark, d, "work_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark IS NOT NULL").select("field_name", "term", "mark")


def p3_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """The index itself: one united bitmap per term and chunk."""
    s, w = table(spark, d, "sections"), table(spark, d, "work_items")
    return terms.corpus_bitmaps(s, w, terms.record_totals(s, w))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The record map of the index: which section_id each bit stands for."""
    s, w = table(spark, d, "sections"), table(spark, d, "work_items")
    return terms.corpus_records(s, w, terms.record_totals(s, w))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    split = pieces.split_oversized(table(spark, d, "sections"), table(spark, d, "section_config"))
    return split.where("piece_no = 1 AND n_pieces > 1").select("section_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.all_pieces(table(spark, d, "sections"), table(spark, d, "section_config"))


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    return pieces.piece_checks(table(spark, d, "sections"), table(spark, d, "section_config"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "section_vectors"), "stable_chunk_uid", "dense")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id hash is divisible by 100, against all vectors."""
    asks = lambda uid: F.pmod(F.xxhash64(uid), F.lit(100)) == 0
    near = neighbours.nearest_neighbours(table(spark, d, "section_vectors"), "stable_chunk_uid", "dense", factor=neighbours.OPEN_FACTOR, asks=asks)
    return near.select("uid", "other", F.round("cosine", 6).alias("cosine"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_removals(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms, "p3_bitmaps": p3_bitmaps, "p3_records": p3_records, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_checks": p4_checks, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_ids": p6_ids, "p7_found": p7_found, "p7_spans": p7_spans, "p7_removals": p7_removals, "p8_found": p8_found}

_TERMS = r"""WITH texts AS (SELECT section_id, max(text) AS v FROM sections WHERE section_id IS NOT NULL GROUP BY section_id),
lists AS (SELECT section_id, max(identifiers) AS v FROM work_items WHERE section_id IS NOT NULL GROUP BY section_id),
raw AS (
  SELECT 'text' AS field_name, section_id, lower(unnest(regexp_extract_all(v, '[\p{L}\p{N}_]+'))) AS term FROM texts
  UNION ALL SELECT 'identifiers', section_id, trim(x, ' ') FROM (SELECT section_id, unnest(v) AS x FROM lists) WHERE NOT regexp_full_match(x, '\s*')),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT section_id) AS records FROM raw GROUP BY ALL),
totals AS (SELECT 'text' AS field_name, count(*) AS total FROM texts UNION ALL SELECT 'identifiers', count(*) FROM lists),
marked AS (SELECT field_name, term, occurrences, records, CASE WHEN records = 1 THEN 'rare' WHEN records * 100 > total * 10 THEN 'common' END AS mark FROM counted JOIN totals USING (field_name))"""

SQL = {
    "p3_found": f"{_TERMS} SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": f"{_TERMS} SELECT * FROM marked",
    "p4_found": """SELECT DISTINCT s.section_id FROM sections s JOIN section_config c ON c.profile = coalesce(s.profile, 'standard') WHERE length(s.text) > c.max_chars""",
    "p4_checks": """SELECT section_id, CAST(max(length(text)) AS BIGINT) AS covered, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS short_overlaps, CAST(0 AS BIGINT) AS wrong_texts
FROM sections WHERE section_id IS NOT NULL AND length(text) > 0 GROUP BY section_id""",
    "p5_found": """WITH v AS (
  SELECT DISTINCT stable_chunk_uid AS uid, CAST(dense AS DOUBLE[]) AS x FROM section_vectors
  WHERE stable_chunk_uid IS NOT NULL AND len(dense) = 64 AND len(list_filter(dense, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(dense, lambda e: e <> 0)) > 0)
SELECT DISTINCT a.uid AS uid_a, b.uid AS uid_b FROM v a JOIN v b ON a.uid < b.uid WHERE list_cosine_similarity(a.x, b.x) >= 0.95""",
}
