"""Queries on the text functions and the Markdown operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import markdown as M
from docloom.sources.tables import table

_C = F.col


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """One row per section: the columns here are the same in all its rows."""
    return table(spark, d, "sections").where("section_id IS NOT NULL").select("section_id", "source_document_id", "heading_path", "text").distinct()


def section_hashes(spark: SparkSession, d: str) -> DataFrame:
    last = F.element_at("heading_path", -1)
    return _sections(spark, d).select("section_id", F.when(F.size("heading_path") > 0, T.slug(last)).alias("slug"), T.source_hash(_C("text")).alias("source_hash"), T.semantic_hash(_C("text")).alias("semantic_hash"))


def semantic_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("length(trim(text)) > 0").select(T.semantic_hash(_C("text")).alias("semantic_hash"), "doc_id")
    return rows.groupBy("semantic_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def section_summary(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("section_id", T.fallback_summary(_C("heading_path"), _C("text")).alias("summary"))


def section_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("section_id", T.identifiers(_C("heading_path"), _C("text")).alias("identifiers"))


def section_search_keys(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "work_items").where("section_id IS NOT NULL").select("section_id", "identifiers").distinct()
    rows = _sections(spark, d).join(items, "section_id", "left")
    return rows.select("section_id", T.search_keys(_C("heading_path"), _C("identifiers")).alias("search_keys"))


def evidence_specific_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "related_section_candidates").select("candidate_id", "evidence_terms").distinct()
    return rows.select("candidate_id", T.specific_terms(_C("evidence_terms")).alias("terms"))


def section_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "work_items").where("section_id IS NOT NULL").select("section_id", "identifiers").distinct()
    rows = _sections(spark, d).join(items, "section_id", "left").withColumn("keys", T.search_keys(_C("heading_path"), _C("identifiers")))
    return rows.select("section_id", T.embedding_text(_C("heading_path"), T.fallback_summary(_C("heading_path"), _C("text")), _C("keys"), _C("identifiers")).alias("embedding_text"))


def section_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d).where("text IS NOT NULL").withColumn("tokens", T.tokens(_C("text")))
    return rows.select("section_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_hash"))


def section_char_grams(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d).where("text IS NOT NULL")
    gram = lambda n: F.sha2(F.array_join(T.char_grams(_C("text"), n), " "), 256)
    return rows.select("section_id", gram(2).alias("grams2"), gram(3).alias("grams3"))


def identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "work_items").select(F.explode("identifiers").alias("name")).where("trim(name) <> ''").distinct()
    return names.select("name", F.array_sort(T.identifier_parts(F.array("name"))).alias("parts"))


def section_point_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("section_id IS NOT NULL").select("section_id").distinct().select("section_id", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", _C("section_id")).alias("point_id"))


def evidence_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Of every candidate pair, how many of its evidence terms occur in the text of either section.

    Each distinct (section, term) meets the section's text once; only the answers go back to the candidates.
    """
    pairs = table(spark, d, "related_section_candidates").where("size(evidence_terms) > 0").select("candidate_id", "source_section_id", "target_section_id", "evidence_terms").distinct()
    terms = F.filter("evidence_terms", lambda t: t.isNotNull() & (F.trim(t) != ""))
    asked = pairs.select("candidate_id", F.explode(F.array_distinct(F.array("source_section_id", "target_section_id"))).alias("section_id"), F.posexplode(terms).alias("place", "term"))
    texts = _sections(spark, d).where("text IS NOT NULL").select("section_id", "text")
    held = asked.where("section_id IS NOT NULL").select("section_id", "term").distinct().join(texts, "section_id").where(F.contains("text", "term")).select("section_id", "term")
    found = asked.join(held, ["section_id", "term"]).groupBy("candidate_id").agg(F.countDistinct("place").cast("int").alias("found"))
    rows = pairs.select("candidate_id", F.size(terms).alias("terms")).join(found, "candidate_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return rows.select("candidate_id", "terms", "found", F.when(_C("terms") > 0, F.round(_C("found") / _C("terms"), 6)).otherwise(F.lit(0.0)).alias("score"))


def section_sparse(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d).where("text IS NOT NULL").select("section_id", T.tokens(_C("text")).alias("tokens"))
    return V.hashed_sparse(rows, "section_id", "tokens")


def section_dense(spark: SparkSession, d: str) -> DataFrame:
    rows = _sections(spark, d).where("text IS NOT NULL").select("section_id", T.tokens(_C("text")).alias("tokens"))
    return V.hashed_dense(rows, "section_id", "tokens", 64)


def vector_sparse_normal(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "section_vectors").select("stable_chunk_uid", "sparse_indices", "sparse_values").distinct()
    return rows.select("stable_chunk_uid", F.explode(V.normal_sparse(_C("sparse_indices"), _C("sparse_values"))).alias("p")).select("stable_chunk_uid", _C("p.index").alias("token_id"), F.round("p.value", 6).alias("weight"))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.document_lines(table(spark, d, "documents")).select("doc_id", "line_no", "start_offset", F.length("line").alias("n_chars"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return M.sections(table(spark, d, "documents")).drop("body")


def markdown_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Sections per chapter in document order; headings above the first chapter belong to none."""
    top = F.when(F.size("heading_path") > 0, T.slug(F.element_at("heading_path", 1))).otherwise(F.lit("document"))
    rows = M.sections(table(spark, d, "documents")).select("doc_id", top.alias("chapter"), "ordinal", "section_id")
    return rows.groupBy("doc_id", "chapter").agg(F.count(F.lit(1)).alias("sections"), F.min("ordinal").alias("first"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "section_id"))), lambda s: s["section_id"]), "\n"), 256).alias("members_hash"))


def document_structure(spark: SparkSession, d: str) -> DataFrame:
    return M.structure_hashes(table(spark, d, "documents"))


def document_links(spark: SparkSession, d: str) -> DataFrame:
    return M.links(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (section_hashes, semantic_copies, section_summary, section_identifiers, section_search_keys, evidence_specific_terms, section_embedding_text, section_tokens, section_char_grams, identifier_parts, section_point_ids, evidence_grounding, section_sparse, section_dense, vector_sparse_normal, document_lines, markdown_sections, markdown_chapters, document_structure, document_links)
}

_WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
_SQL_SECTIONS = "s AS (SELECT DISTINCT section_id, source_document_id, heading_path, text FROM sections WHERE section_id IS NOT NULL)"
_collapse = lambda x: f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'), ' ')"
_slug = lambda x: f"coalesce(nullif(lower(regexp_replace(regexp_replace({x}, '[^0-9A-Za-z_{T.CJK}]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'section')"
_distinct = lambda x: f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"
_SUMMARY = r"""CASE WHEN h <> '' AND l <> '' THEN h || ': ' || l WHEN h <> '' THEN h ELSE l END"""
_HEAD_LINE = r"""SELECT section_id, heading_path, text, trim(coalesce(array_to_string(heading_path, ' / '), ''), ' ') AS h, trim(regexp_extract(coalesce(text, ''), '([^\s][^\r\n]*)', 1), ' ') AS l FROM s"""
_KEYS = f"""keyed AS (
  SELECT s.section_id, s.heading_path, s.text, w.identifiers, list_filter(list_transform(coalesce(heading_path, []), lambda x: {_collapse('x')}), lambda x: x <> '') AS k
  FROM s LEFT JOIN (SELECT DISTINCT section_id, identifiers FROM work_items WHERE section_id IS NOT NULL) w USING (section_id)),
keys AS (SELECT *, list_filter({_distinct('k')}, lambda x: NOT regexp_full_match(x, '{T.KEY_SHAPES}') AND NOT coalesce(list_contains(coalesce(identifiers, []), x), false))[1:12] AS search_keys FROM keyed)"""
_TOKENS = rf"""t AS (SELECT section_id, replace(lower(text), '　', ' ') AS x FROM s WHERE text IS NOT NULL),
tok AS (SELECT section_id, list_concat(regexp_extract_all(x, '{T.TOKEN}'), flatten(list_transform(regexp_extract_all(x, '[{T.CJK}]{{3,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))) AS tokens FROM t)"""
_RUNS = r"'[\p{L}\p{N}_]+'"
_B = r"(?:^|[^\p{L}\p{N}_])"
_IDENT = rf"""x AS (SELECT section_id, concat_ws(chr(10), array_to_string(coalesce(heading_path, []), chr(10)), coalesce(text, '')) AS t, len(coalesce(heading_path, [])) AS nh, coalesce(text, '') AS body FROM s),
y AS (SELECT section_id, CASE WHEN nh = 0 THEN body ELSE t END AS t FROM x),
z AS (SELECT section_id, list_filter(list_transform(flatten([
  regexp_extract_all(t, '`([^`\n]+)`', 1), regexp_extract_all(replace(t, ']', ']]'), '{_B}\[([A-Za-z_][A-Za-z0-9_.\-]*)\]', 1), regexp_extract_all(t, '(?m)^\s*([A-Za-z_][A-Za-z0-9_.\-]*)\s*=', 1),
  list_filter(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}_.]+'), lambda e: regexp_replace(e, '^\.+|\.+$', '', 'g')), lambda e: regexp_full_match(e, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+')),
  regexp_extract_all(replace(t, ')', '))'), '{_B}([A-Za-z_][A-Za-z0-9_]*\(\))', 1), list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_.\-]+'), lambda e: regexp_full_match(e, '[A-Za-z0-9_.\-]+\.(?:json|toml|ya?ml|md|py|txt|lock)')),
  regexp_extract_all(replace(t, '-/', '- /'), '{_B}(/[A-Za-z][A-Za-z0-9_\-]*)', 1), regexp_extract_all(t, '{_B}(--[A-Za-z0-9][A-Za-z0-9_\-]*)', 1),
  list_filter(regexp_extract_all(t, {_RUNS}), lambda e: regexp_full_match(e, '[A-Z][A-Z0-9_]{{2,}}')), list_filter(regexp_extract_all(t, {_RUNS}), lambda e: regexp_full_match(e, '[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*')),
  list_filter(regexp_extract_all(t, {_RUNS}), lambda e: regexp_full_match(e, '[a-z][a-z0-9]*(?:_[a-z0-9]+)+') AND regexp_matches(e, '{"|".join(T.WARNING_MARKERS)}')),
  list_filter({list(T.STATUS_WORDS)!r}, lambda e: list_contains(regexp_extract_all(t, {_RUNS}), e))
]), lambda e: {_collapse('e')}), lambda e: e <> '') AS f FROM y)"""
_LINES = r"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0),
lines AS (SELECT doc_id, n AS line_no, off AS start_offset, regexp_replace(raw, '\r$', '') AS line FROM (
  SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, lead(n) OVER (PARTITION BY doc_id ORDER BY n) AS follows FROM raw)
  WHERE follows IS NOT NULL OR raw <> '')"""
# fenced code by a walk over the lines that look like fences, one after the other
_CODE = r"""fl AS (SELECT doc_id, line_no, regexp_extract(line, '^ *([`~]+)', 1) AS run, trim(replace(regexp_extract(line, '^ *[`~]+(.*)$', 1), chr(9), ' '), ' ') AS info, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k
  FROM lines WHERE regexp_matches(line, '^ {0,3}(```|~~~)')),
fr AS (SELECT doc_id, line_no, k, CASE WHEN run[1] = '`' THEN regexp_extract(run, '^`+') ELSE regexp_extract(run, '^~+') END AS run, CASE WHEN run[1] = '`' THEN regexp_replace(run, '^`+', '') ELSE regexp_replace(run, '^~+', '') END || info AS info FROM fl),
walk AS (SELECT doc_id, 0 AS k, 0 AS line_no, '' AS open, '' AS kind FROM (SELECT DISTINCT doc_id FROM fr)
  UNION ALL SELECT fr.doc_id, fr.k, fr.line_no,
    CASE WHEN open = '' AND (fr.run[1] = '~' OR position('`' IN fr.info) = 0) THEN fr.run WHEN open <> '' AND fr.run[1] = open[1] AND length(fr.run) >= length(open) AND fr.info = '' THEN '' ELSE open END,
    CASE WHEN open = '' AND (fr.run[1] = '~' OR position('`' IN fr.info) = 0) THEN 'opens' WHEN open <> '' AND fr.run[1] = open[1] AND length(fr.run) >= length(open) AND fr.info = '' THEN 'closes' ELSE '' END
  FROM walk JOIN fr ON fr.doc_id = walk.doc_id AND fr.k = walk.k + 1),
f AS (SELECT l.*, coalesce(sum(CASE kind WHEN 'opens' THEN 1 WHEN 'closes' THEN -1 END) OVER (PARTITION BY l.doc_id ORDER BY l.line_no), 0) > 0 OR coalesce(kind, '') = 'closes' AS in_code FROM lines l LEFT JOIN walk ON walk.doc_id = l.doc_id AND walk.line_no = l.line_no)"""
_ATX_SQL, _SETEXT_SQL = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", r"^ {0,3}(?:=+|-+)[ \t]*$"
_NOT_TEXT_SQL = r"^[ \t]*$|^ {0,3}(?:#{1,6}(?:[ \t]|$)|[-*+][ \t]|[0-9]{1,9}[.)][ \t]|\||>|```|~~~|=+[ \t]*$|-+[ \t]*$)"
_MD = rf"""{_LINES}, {_CODE},
g AS (SELECT *, lead(line) OVER w AS nl, lead(in_code) OVER w AS nc, lag(line) OVER w AS pl, lag(in_code) OVER w AS pc FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
h AS (SELECT *, NOT in_code AND regexp_matches(line, '{_ATX_SQL}') AS atx,
  NOT in_code AND NOT regexp_matches(line, '{_NOT_TEXT_SQL}') AND (pl IS NULL OR pc OR regexp_matches(pl, '{_NOT_TEXT_SQL}')) AND NOT coalesce(nc, true) AND coalesce(regexp_matches(nl, '{_SETEXT_SQL}'), false) AS setext FROM g),
l0 AS (SELECT *, CASE WHEN atx THEN length(regexp_extract(line, '{_ATX_SQL}', 1)) WHEN setext THEN CASE WHEN regexp_matches(nl, '^ {{0,3}}=') THEN 1 ELSE 2 END END AS lv FROM h),
l1 AS (SELECT doc_id, line_no, line, CASE WHEN lv <= 4 THEN lv END AS level, CASE WHEN lv <= 4 THEN trim(CASE WHEN atx THEN regexp_extract(line, '{_ATX_SQL}', 2) ELSE line END, ' ') END AS heading, setext FROM l0),
l2 AS (SELECT *, coalesce(lag(setext AND level IS NOT NULL) OVER w, false) AS underline, count(level) OVER w AS ordinal, count(level) OVER (PARTITION BY doc_id) AS total,
  {", ".join(f"last_value(CASE WHEN level = {n} THEN line_no END IGNORE NULLS) OVER w AS a{n}, last_value(CASE WHEN level = {n} THEN heading END IGNORE NULLS) OVER w AS h{n}" for n in range(1, 5))}
  FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
l3 AS (SELECT *, list_filter([{", ".join(f"CASE WHEN a{n} >= greatest({', '.join(f'coalesce(a{m}, 0)' for m in range(1, n + 1))}, 0) THEN h{n} END" for n in range(1, 5))}], lambda e: e IS NOT NULL) AS path FROM l2 WHERE ordinal > 0 OR total = 0),
secs AS (SELECT doc_id, ordinal, max(level) AS level, max(heading) AS heading, coalesce(max(path) FILTER (level IS NOT NULL), []) AS heading_path, min(line_no) AS start_line, max(line_no) AS end_line,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (level IS NULL AND NOT underline), '') AS body FROM l3 GROUP BY doc_id, ordinal),
done AS (SELECT doc_id, ordinal, level, heading, heading_path, start_line, end_line, sha256(body) AS source_hash, sha256({_collapse('body')}) AS semantic_hash,
  doc_id || '#' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(4, length(CAST(ordinal AS VARCHAR))) AS INTEGER), '0') || '-' || coalesce({_slug('heading')}, 'document') AS section_id0,
  CASE WHEN heading IS NULL THEN doc_id || '#' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(4, length(CAST(ordinal AS VARCHAR))) AS INTEGER), '0') || '-document' END AS root_id,
  substring(sha256(doc_id || chr(10) || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(4, length(CAST(ordinal AS VARCHAR))) AS INTEGER), '0')), 1, 16) AS stable_section_uid FROM secs)"""

SQL = {
    "section_hashes": f"WITH {_SQL_SECTIONS} SELECT section_id, CASE WHEN len(heading_path) > 0 THEN {_slug('heading_path[-1]')} END AS slug, sha256(text) AS source_hash, sha256({_collapse('text')}) AS semantic_hash FROM s",
    "semantic_copies": f"SELECT sha256({_collapse('text')}) AS semantic_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE length(trim(text, ' ')) > 0 GROUP BY 1 HAVING count(*) > 1",
    "section_summary": f"WITH {_SQL_SECTIONS} SELECT section_id, {_SUMMARY} AS summary FROM ({_HEAD_LINE})",
    "section_identifiers": f"WITH {_SQL_SECTIONS}, {_IDENT} SELECT section_id, ({_distinct('f')})[1:64] AS identifiers FROM z",
    "section_search_keys": f"WITH {_SQL_SECTIONS}, {_KEYS} SELECT section_id, search_keys FROM keys",
    "evidence_specific_terms": f"SELECT candidate_id, list_filter(coalesce(evidence_terms, []), lambda x: x IS NOT NULL AND length(trim(x, ' ')) >= 4 AND NOT regexp_full_match(trim(x, ' '), '\\p{{Nd}}+') AND NOT list_contains({list(T.GENERIC_TERMS)!r}, lower({_collapse('x')}))) AS terms FROM (SELECT DISTINCT candidate_id, evidence_terms FROM related_section_candidates)",
    "section_embedding_text": f"""WITH {_SQL_SECTIONS}, {_KEYS}, b AS (SELECT section_id, heading_path, search_keys, identifiers, trim(coalesce(array_to_string(heading_path, ' / '), ''), ' ') AS h, trim(regexp_extract(coalesce(text, ''), '([^\\s][^\\r\\n]*)', 1), ' ') AS l FROM keys)
SELECT section_id, array_to_string(list_filter([array_to_string(coalesce(heading_path, []), ' / '), {_SUMMARY}, array_to_string(search_keys[1:8], ', '), array_to_string(coalesce(identifiers, [])[1:8], ', ')], lambda e: e IS NOT NULL AND e <> ''), ' | ') AS embedding_text FROM b""",
    "section_tokens": f"WITH {_SQL_SECTIONS}, {_TOKENS} SELECT section_id, len(tokens) AS n_tokens, sha256(array_to_string(tokens, ' ')) AS tokens_hash FROM tok",
    "section_char_grams": f"""WITH {_SQL_SECTIONS}, c AS (SELECT section_id, regexp_replace(lower(text), '{_WS}', '', 'g') AS x FROM s WHERE text IS NOT NULL)
SELECT section_id, sha256(coalesce(array_to_string(list_transform(range(1, length(x)), lambda i: substring(x, i, 2)), ' '), '')) AS grams2, sha256(coalesce(array_to_string(list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3)), ' '), '')) AS grams3 FROM c""",
    "identifier_parts": r"""WITH n AS (SELECT DISTINCT name FROM (SELECT unnest(identifiers) AS name FROM work_items) WHERE trim(name, ' ') <> ''),
p AS (SELECT name, regexp_split_to_array(name, '[./:@#\-]+') AS parts FROM n),
q AS (SELECT name, parts, flatten(list_transform(parts, lambda e: string_split(regexp_replace(e, '([a-z0-9])([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))) AS camel FROM p)
SELECT name, list_sort(list_distinct(list_transform(list_concat([name], list_filter(list_concat(parts, camel), lambda e: length(e) >= 2)), lambda e: lower(e)))) AS parts FROM q""",
    "evidence_grounding": f"""WITH {_SQL_SECTIONS}, c AS (SELECT DISTINCT candidate_id, source_section_id, target_section_id, evidence_terms FROM related_section_candidates WHERE len(evidence_terms) > 0),
b AS (SELECT c.candidate_id, list_filter(c.evidence_terms, lambda t: t IS NOT NULL AND trim(t, ' ') <> '') AS terms, concat_ws(chr(10), a.x, b.x) AS corpus FROM c
  LEFT JOIN (SELECT section_id, coalesce(text, '') AS x FROM s) a ON a.section_id = c.source_section_id LEFT JOIN (SELECT section_id, coalesce(text, '') AS x FROM s) b ON b.section_id = c.target_section_id),
h AS (SELECT candidate_id, len(terms) AS terms, len(list_filter(terms, lambda t: contains(corpus, t))) AS found FROM b)
SELECT candidate_id, terms, found, CASE WHEN terms > 0 THEN round(found / terms, 6) ELSE 0.0 END AS score FROM h""",
    "section_sparse": f"WITH {_SQL_SECTIONS}, {_TOKENS} SELECT section_id, CAST(('0x' || substring(sha256(token), 1, 8)) AS BIGINT) AS token_id, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT section_id, unnest(tokens) AS token FROM tok) GROUP BY ALL",
    "section_dense": f"""SELECT section_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY section_id)), 6) AS value FROM (WITH {_SQL_SECTIONS}, {_TOKENS} SELECT section_id, CAST(CAST(('0x' || substring(sha256(token), 1, 8)) AS BIGINT) % 64 AS INTEGER) AS slot,
CAST(sum(CASE WHEN CAST(('0x' || substring(sha256(token), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM (SELECT section_id, unnest(tokens) AS token FROM tok) GROUP BY 1, 2 HAVING v <> 0)""",
    "vector_sparse_normal": """WITH v AS (SELECT DISTINCT stable_chunk_uid, sparse_indices, sparse_values FROM section_vectors),
p AS (SELECT stable_chunk_uid, sparse_indices, sparse_values, unnest(sparse_indices) AS token_id, unnest(sparse_values) AS w FROM v)
SELECT stable_chunk_uid, token_id, round(sum(CAST(w AS DOUBLE)), 6) AS weight FROM p WHERE token_id IS NOT NULL AND w IS NOT NULL AND isfinite(w) GROUP BY stable_chunk_uid, sparse_indices, sparse_values, token_id HAVING sum(CAST(w AS DOUBLE)) <> 0""",
    "document_lines": f"WITH {_LINES} SELECT doc_id, line_no, start_offset, length(line) AS n_chars FROM lines",
    "markdown_sections": f"WITH RECURSIVE {_MD} SELECT doc_id, ordinal, level, heading, heading_path, start_line, end_line, source_hash, semantic_hash, coalesce(root_id, section_id0) AS section_id, stable_section_uid FROM done",
    "markdown_chapters": f"""WITH RECURSIVE {_MD}, c AS (SELECT doc_id, CASE WHEN len(heading_path) > 0 THEN {_slug('heading_path[1]')} ELSE 'document' END AS chapter, ordinal, coalesce(root_id, section_id0) AS section_id FROM done)
SELECT doc_id, chapter, count(*) AS sections, min(ordinal) AS first, sha256(string_agg(section_id, chr(10) ORDER BY ordinal)) AS members_hash FROM c GROUP BY ALL""",
    "section_point_ids": """WITH h AS (SELECT section_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(section_id)) AS x FROM (SELECT DISTINCT section_id FROM sections WHERE section_id IS NOT NULL))
SELECT section_id, concat_ws('-', substring(x, 1, 8), substring(x, 9, 4), '5' || substring(x, 14, 3), substring('89ab', CAST(CAST('0x' || substring(x, 17, 1) AS INTEGER) % 4 + 1 AS BIGINT), 1) || substring(x, 18, 3), substring(x, 21, 12)) AS point_id FROM h""",
    "document_structure": f"""WITH RECURSIVE {_LINES}, {_CODE},
p AS (SELECT doc_id, line_no, CASE WHEN in_code THEN 'code:' || line ELSE {_collapse('line')} END AS part FROM f)
SELECT doc_id, count(*) AS lines, sha256(string_agg(part, chr(10) ORDER BY line_no)) AS structure_hash FROM p WHERE part <> '' GROUP BY doc_id""",
    "document_links": r"""SELECT doc_id, position - 1 AS position, label, target FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^!])\[([^\]\n]+)\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1)) AS label, unnest(regexp_extract_all(text, '(?:^|[^!])\[([^\]\n]+)\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 2)) AS target,
  generate_subscripts(regexp_extract_all(text, '(?:^|[^!])\[([^\]\n]+)\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1), 1) AS position FROM documents)""",
}
