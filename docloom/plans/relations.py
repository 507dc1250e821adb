"""Queries on relations, coverage and reconciliation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import markdown as M
from docloom.operators import relations as L
from docloom.plans.corpus import _SNAP, _snapshot
from docloom.plans.text import _LINES, _collapse
from docloom.sources.tables import table

_C = F.col


def _live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("section_id IS NOT NULL AND deleted_at IS NULL").select("section_id").distinct()


def candidate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return L.validate_targets(table(spark, d, "related_section_candidates"), _live(spark, d))


def relation_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Relations after the last snapshot: of changed sources only those of exact channels, of the others the old ones."""
    rows = table(spark, d, "related_section_candidates").where("trim(source_section_id) <> '' AND trim(target_section_id) <> ''")
    pairs = lambda df: df.select(_C("source_section_id").alias("src"), _C("target_section_id").alias("dst"))
    states = L.reconcile(_snapshot(spark, d, 1), _snapshot(spark, d, 0), "section_id", "stable_section_uid", "source_hash", "semantic_hash")
    changed = states.where("state IN ('changed', 'added', 'renamed')").select(_C("new_key").alias("key"))
    exact = rows.where("arrays_overlap(channels, array('markdown_link', 'shared_identifier'))")
    return L.inherit(pairs(rows), pairs(exact), changed, _snapshot(spark, d, 0).select(_C("section_id").alias("key")))


def dominant_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "related_section_candidates").select("candidate_id", "source_document_id", F.explode("channels").alias("channel")).distinct()
    return L.dominant(rows, "source_document_id", "channel")


def chapter_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of the last manifest's chapters, how many sections have a vector."""
    return L.coverage(_snapshot(spark, d, 0), table(spark, d, "section_vectors").select(_C("source_section_id").alias("section_id")), "chapter_id", "section_id")


def manifest_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return L.reconcile(_snapshot(spark, d, 1), _snapshot(spark, d, 0), "section_id", "stable_section_uid", "source_hash", "semantic_hash").where("state <> 'unchanged'")


def manifest_states(spark: SparkSession, d: str) -> DataFrame:
    states = L.reconcile(_snapshot(spark, d, 1), _snapshot(spark, d, 0), "section_id", "stable_section_uid", "source_hash", "semantic_hash")
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Per document, how many sections of the last snapshot have an embedding text of the snapshot before it."""
    key = lambda df: df.withColumn("cache_key", F.sha2(F.concat_ws("|", "section_id", F.coalesce("semantic_hash", F.lit(""))), 256))
    probed = L.cache_probe(key(_snapshot(spark, d, 0)), key(_snapshot(spark, d, 1)), "cache_key")
    return probed.groupBy("source_document_id").agg(F.count_if("hit").alias("reused"), F.count_if(~_C("hit")).alias("computed"))


def review_batches(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs in batches of five per document."""
    rows = table(spark, d, "related_section_candidates").select("source_document_id", "candidate_id").where("source_document_id IS NOT NULL").distinct()
    return L.batches(rows, "source_document_id", ["candidate_id"], 5).groupBy("source_document_id", "batch").agg(F.min("candidate_id").alias("first"), F.count(F.lit(1)).alias("n"))


def document_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, paragraph, first_line, last_line): runs of lines between blank ones."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no")
    lines = M.document_lines(table(spark, d, "documents")).withColumn("blank", _C("line").rlike(r"^[ \t\r]*$"))
    starts = ~_C("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))
    rows = lines.withColumn("paragraph", F.count(F.when(starts, 1)).over(w)).where("NOT blank")
    return rows.groupBy("doc_id", "paragraph").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def severity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Conflict severities as numbers: words have fixed values, numbers count as they are, the rest is 0.6."""
    level = F.lower(F.trim("severity"))
    score = F.when(level == "low", 0.25).when(level == "medium", 0.6).when(level == "high", 0.9).otherwise(F.coalesce(F.expr("try_cast(severity AS double)"), F.lit(0.6)))
    return table(spark, d, "conflict_review_items").select("conflict_id", "status", score.alias("score")).distinct().groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def retained_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations that outlive the last snapshot: both ends are still there and neither has changed."""
    rows = table(spark, d, "related_section_candidates").where("trim(source_section_id) <> '' AND trim(target_section_id) <> ''").select(_C("source_section_id").alias("src"), _C("target_section_id").alias("dst")).distinct()
    states = L.reconcile(_snapshot(spark, d, 1), _snapshot(spark, d, 0), "section_id", "stable_section_uid", "source_hash", "semantic_hash")
    steady = states.where("state IN ('unchanged', 'format_only')").select(_C("new_key").alias("key"))
    return rows.join(steady.withColumnRenamed("key", "src"), "src", "left_semi").join(steady.withColumnRenamed("key", "dst"), "dst", "left_semi").select("src", "dst")


def section_id_sets(spark: SparkSession, d: str) -> DataFrame:
    """How many ids occur in which of the three section tables."""
    ids = lambda name, c: table(spark, d, name).where(_C(c).isNotNull()).select(_C(c).alias("id"), F.lit(name).alias("name")).distinct()
    rows = ids("sections", "section_id").unionByName(ids("section_vectors", "source_section_id")).unionByName(ids("work_items", "section_id"))
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), "+").alias("tables")).groupBy("tables").agg(F.count(F.lit(1)).alias("n"))


def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """A vector of eight numbers in [0, 1] per document: the bytes of the text's hash."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    byte = lambda i: F.round(F.conv(F.substring(digest, 1 + 2 * i, 2), 16, 10).cast("double") / 255, 6)
    return table(spark, d, "documents").select("doc_id", F.array(*[byte(i) for i in range(8)]).alias("x"))


def snippet_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """How often each evidence snippet occurs in the text of the candidate's source section, white space aside."""
    rows = table(spark, d, "related_section_candidates").select("candidate_id", "source_section_id", F.explode("evidence_snippets").alias("snippet")).where("trim(snippet) <> '' AND source_section_id IS NOT NULL").distinct()
    texts = table(spark, d, "sections").where("section_id IS NOT NULL AND text IS NOT NULL").select(_C("section_id").alias("source_section_id"), "text").distinct()
    n = T.occurrences(T.collapse(_C("text")), T.collapse(_C("snippet")))
    return rows.join(texts, "source_section_id").select("candidate_id", "snippet", n.alias("n"))


QUERIES = {f.__name__: f for f in (candidate_verdicts, relation_inheritance, dominant_channels, chapter_coverage, manifest_reconcile, manifest_states, embedding_reuse, review_batches, document_paragraphs, severity_scores, retained_relations, section_id_sets, hash_embeddings, snippet_occurrences)}

_REC = f"""{_SNAP}, j AS (SELECT a.section_id AS old_key, b.section_id AS new_key, coalesce(a.stable_section_uid, b.stable_section_uid) AS uid,
CASE WHEN coalesce(a.semantic_hash <> b.semantic_hash, false) THEN 'changed' WHEN coalesce(a.source_hash <> b.source_hash, false) THEN 'format_only' ELSE 'unchanged' END AS st FROM a FULL JOIN b ON a.section_id = b.section_id),
uq AS (SELECT uid, min(old_key) AS old_key, min(new_key) AS new_key FROM j WHERE (old_key IS NULL OR new_key IS NULL) AND uid IS NOT NULL GROUP BY uid HAVING count(old_key) = 1 AND count(new_key) = 1),
rec AS (SELECT old_key, new_key, st AS state FROM j WHERE old_key IS NOT NULL AND new_key IS NOT NULL UNION ALL SELECT old_key, new_key, 'renamed' FROM uq
UNION ALL SELECT old_key, new_key, CASE WHEN old_key IS NULL THEN 'added' ELSE 'removed' END FROM j WHERE (old_key IS NULL OR new_key IS NULL) AND coalesce(old_key, new_key) NOT IN (SELECT old_key FROM uq UNION SELECT new_key FROM uq))"""

SQL = {
    "candidate_verdicts": """WITH l AS (SELECT DISTINCT section_id FROM sections WHERE section_id IS NOT NULL AND deleted_at IS NULL), c AS (SELECT DISTINCT candidate_id, source_section_id AS s, target_section_id AS t FROM related_section_candidates)
SELECT candidate_id, CASE WHEN coalesce(trim(s, ' ') = '', true) THEN 'blank_source' WHEN coalesce(trim(t, ' ') = '', true) THEN 'blank_target' WHEN s = t THEN 'self' WHEN s NOT IN (SELECT section_id FROM l) THEN 'unknown_source' WHEN t NOT IN (SELECT section_id FROM l) THEN 'unknown_target' ELSE 'kept' END AS verdict FROM c""",
    "relation_inheritance": f"""{_REC}, ck AS (SELECT new_key AS k FROM rec WHERE state IN ('changed', 'added', 'renamed')),
c AS (SELECT source_section_id AS src, target_section_id AS dst, coalesce(list_has_any(channels, ['markdown_link', 'shared_identifier']), false) AS exact FROM related_section_candidates WHERE trim(source_section_id, ' ') <> '' AND trim(target_section_id, ' ') <> '')
SELECT DISTINCT src, dst, 'inherited' AS origin FROM c WHERE src NOT IN (SELECT k FROM ck) AND dst IN (SELECT section_id FROM b) UNION ALL SELECT DISTINCT src, dst, 'recomputed' FROM c WHERE exact AND src IN (SELECT k FROM ck)""",
    "dominant_channels": """WITH r AS (SELECT DISTINCT candidate_id, source_document_id, unnest(channels) AS channel FROM related_section_candidates), n AS (SELECT source_document_id, channel, count(*) AS n FROM r WHERE source_document_id IS NOT NULL AND channel IS NOT NULL GROUP BY ALL)
SELECT source_document_id, channel, n FROM (SELECT *, row_number() OVER (PARTITION BY source_document_id ORDER BY n DESC, channel) AS p FROM n) WHERE p = 1""",
    "chapter_coverage": f"""{_SNAP}, v AS (SELECT DISTINCT source_section_id AS section_id, 1 AS there FROM section_vectors WHERE source_section_id IS NOT NULL), m AS (SELECT chapter_id, count(*) AS members, count(there) AS covered FROM (SELECT DISTINCT chapter_id, section_id FROM b WHERE chapter_id IS NOT NULL) LEFT JOIN v USING (section_id) GROUP BY 1)
SELECT *, CASE WHEN covered / members >= 0.75 THEN 'high' WHEN covered > 0 THEN 'medium' ELSE 'low' END AS level FROM m""",
    "manifest_reconcile": f"{_REC} SELECT * FROM rec WHERE state <> 'unchanged'",
    "manifest_states": f"{_REC} SELECT state, count(*) AS n FROM rec GROUP BY state",
    "embedding_reuse": f"""{_SNAP}, k AS (SELECT DISTINCT section_id || '|' || coalesce(semantic_hash, '') AS x FROM a), p AS (SELECT source_document_id, (section_id || '|' || coalesce(semantic_hash, '')) IN (SELECT x FROM k) AS hit FROM b)
SELECT source_document_id, count(*) FILTER (hit) AS reused, count(*) FILTER (NOT hit) AS computed FROM p GROUP BY 1""",
    "review_batches": """WITH r AS (SELECT DISTINCT source_document_id, candidate_id FROM related_section_candidates WHERE source_document_id IS NOT NULL), n AS (SELECT *, (row_number() OVER (PARTITION BY source_document_id ORDER BY candidate_id) - 1) // 5 AS batch FROM r)
SELECT source_document_id, batch, min(candidate_id) AS first, count(*) AS n FROM n GROUP BY ALL""",
    "document_paragraphs": rf"""WITH {_LINES}, m AS (SELECT doc_id, line_no, regexp_full_match(line, '[ \t\r]*') AS blank FROM lines), s AS (SELECT *, NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS starts FROM m),
p AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM s)
SELECT doc_id, paragraph, min(line_no) AS first_line, max(line_no) AS last_line FROM p WHERE NOT blank GROUP BY 1, 2""",
    "severity_scores": """WITH r AS (SELECT DISTINCT conflict_id, status, CAST(CASE lower(trim(severity, ' ')) WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.6 WHEN 'high' THEN 0.9 ELSE coalesce(try_cast(severity AS DOUBLE), 0.6) END AS DOUBLE) AS score FROM conflict_review_items)
SELECT status, count(*) AS n, round(avg(score), 6) AS mean_score FROM r GROUP BY status""",
    "retained_relations": f"""{_REC}, k AS (SELECT new_key FROM rec WHERE state IN ('unchanged', 'format_only'))
SELECT DISTINCT source_section_id AS src, target_section_id AS dst FROM related_section_candidates WHERE trim(source_section_id, ' ') <> '' AND trim(target_section_id, ' ') <> '' AND source_section_id IN (SELECT new_key FROM k) AND target_section_id IN (SELECT new_key FROM k)""",
    "section_id_sets": """WITH r AS (SELECT section_id AS id, 'sections' AS name FROM sections UNION SELECT source_section_id, 'section_vectors' FROM section_vectors UNION SELECT section_id, 'work_items' FROM work_items),
g AS (SELECT id, string_agg(name, '+' ORDER BY name) AS tables FROM r WHERE id IS NOT NULL GROUP BY id) SELECT tables, count(*) AS n FROM g GROUP BY tables""",
    "hash_embeddings": "SELECT doc_id, list_transform(range(0, 8), lambda i: round(CAST(CAST('0x' || substring(sha256(coalesce(text, '')), 1 + 2 * i, 2) AS BIGINT) AS DOUBLE) / 255, 6)) AS x FROM documents",
    "snippet_occurrences": f"""WITH r AS (SELECT DISTINCT candidate_id, source_section_id, snippet FROM (SELECT candidate_id, source_section_id, unnest(evidence_snippets) AS snippet FROM related_section_candidates) WHERE trim(snippet, ' ') <> ''),
t AS (SELECT DISTINCT section_id, {_collapse('text')} AS x FROM sections WHERE text IS NOT NULL)
SELECT candidate_id, snippet, CAST(CASE WHEN length(s) > 0 THEN (length(x) - length(replace(x, s, ''))) // length(s) ELSE 0 END AS INTEGER) AS n FROM (SELECT r.*, {_collapse('r.snippet')} AS s, x FROM r JOIN t ON section_id = source_section_id)""",
}
