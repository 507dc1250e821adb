"""Search queries: evaluation items against sections, and vectors against vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import search as S
from docloom.plans.text import _SQL_SECTIONS
from docloom.sources.tables import table

_C = F.col


def _rows(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "sections").where("section_id IS NOT NULL AND text IS NOT NULL").select("section_id", "text").distinct()
    return sections.select(_C("section_id").alias("row_id"), T.tokens(_C("text")).alias("terms"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").where("item_id IS NOT NULL AND text IS NOT NULL").select(_C("item_id").alias("query_id"), "text").distinct()
    return S.term_counts(items, "query_id", T.tokens(_C("text")))


def sparse_search(spark: SparkSession, d: str) -> DataFrame:
    weights = _queries(spark, d).select("query_id", _C("token").alias("term"), _C("n").cast("double").alias("weight"))
    return S.term_top_k(_rows(spark, d), weights, 20)


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25_top_k(_rows(spark, d), S.capped_terms(_queries(spark, d), 80), 12)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Counts of shared tokens and BM25, fused."""
    return S.fuse({"sparse": sparse_search(spark, d), "bm25": bm25_search(spark, d)}, 8)


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(_C("vec_id").alias("row_id"), _C("embedding").alias("x"))


def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    rows = _embeddings(spark, d)
    return S.dense_top_k(rows, rows.where("row_id % 100 = 0").select(_C("row_id").alias("query_id"), "x"), 12, 64)


def _asks(uid: str) -> Column:
    """Whether the id, a hexadecimal number, is divisible by 100 in its first eight digits."""
    return F.pmod(F.conv(F.substring(uid, 1, 8), 16, 10).cast("long"), F.lit(100)) == 0


def section_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Every section vector whose id hash is divisible by 100 against all section vectors."""
    v = table(spark, d, "section_vectors").select(_C("stable_chunk_uid").alias("row_id"), _C("dense").alias("x")).where("size(x) = 64").distinct()
    return S.dense_top_k(v, v.where(_asks("row_id")).select(_C("row_id").alias("query_id"), "x"), 12, 64)


def section_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse channel of every section vector whose id hash is divisible by 100 against all of them, fused."""
    v = table(spark, d, "section_vectors").where("stable_chunk_uid IS NOT NULL").select("stable_chunk_uid", "dense", "sparse_indices", "sparse_values").distinct()
    dense = v.select(_C("stable_chunk_uid").alias("row_id"), _C("dense").alias("x")).where("size(x) = 64")
    pairs = V.normal_sparse(_C("sparse_indices"), _C("sparse_values"))
    sparse = v.select(_C("stable_chunk_uid").alias("row_id"), pairs.alias("p")).where("size(p) > 0").select("row_id", _C("p.index").alias("terms"), _C("p.value").alias("weights"))
    asked = sparse.where(_asks("row_id")).select(_C("row_id").alias("query_id"), F.explode(F.arrays_zip("terms", "weights")).alias("p")).select("query_id", _C("p.terms").alias("term"), _C("p.weights").alias("weight"))
    channels = {"dense": S.dense_top_k(dense, dense.where(_asks("row_id")).select(_C("row_id").alias("query_id"), "x"), 32, 64), "sparse": S.term_top_k(sparse, asked, 32)}
    return S.fuse(channels, 17)


def section_dense_gate(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid hits of a section vector with others, those of a known dense score below 0.55 left out."""
    return S.dense_gate(section_hybrid(spark, d), 0.55, 8)


def candidate_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the vectors of both sections of every candidate pair; null where one has no usable vector."""
    pairs = table(spark, d, "related_section_candidates").select("source_section_id", "target_section_id").where("source_section_id IS NOT NULL AND target_section_id IS NOT NULL").distinct()
    v = table(spark, d, "section_vectors").where("size(dense) = 64").groupBy("source_section_id").agg(F.min(F.struct("stable_chunk_uid", "dense")).alias("v"))
    side = lambda name: v.select(_C("source_section_id").alias(f"{name}_section_id"), _C("v.dense").alias(name))
    both = pairs.join(side("source").withColumnRenamed("source", "a"), "source_section_id", "left").join(side("target").withColumnRenamed("target", "b"), "target_section_id", "left")
    value = V.cosine(_C("a"), _C("b"))
    return both.select("source_section_id", "target_section_id", F.when(~F.isnan(value), F.round(value, 5)).alias("cosine"))


QUERIES = {f.__name__: f for f in (sparse_search, bm25_search, hybrid_search, dense_search, section_vector_search, section_hybrid, section_dense_gate, candidate_similarity)}

_TOK = lambda name, source, key: rf"""{name}_x AS (SELECT {key} AS id, replace(lower(text), '　', ' ') AS x FROM {source}),
{name} AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(list_concat(regexp_extract_all(x, '{T.TOKEN}'), flatten(list_transform(regexp_extract_all(x, '[{T.CJK}]{{3,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))))) AS token FROM {name}_x) GROUP BY ALL)"""  # noqa: E731
_BASE = f"""{_SQL_SECTIONS}, st AS (SELECT DISTINCT section_id, text FROM s WHERE text IS NOT NULL), ei AS (SELECT DISTINCT item_id, text FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
{_TOK('r', 'st', 'section_id')}, {_TOK('q', 'ei', 'item_id')}"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)"
_SPARSE = f"""sp AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM (SELECT q.id AS query_id, r.id AS row_id, CAST(sum(q.n * r.n) AS DOUBLE) AS score FROM q JOIN r USING (token) GROUP BY ALL)) WHERE rank <= 20)"""
_BM25 = f"""qc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, token) AS place FROM q) WHERE place <= 80),
len AS (SELECT id, sum(n) AS length FROM r GROUP BY id), stats AS (SELECT count(*) AS docs, avg(length) AS mean FROM len), df AS (SELECT token, count(*) AS df FROM r GROUP BY token),
bm AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM (
  SELECT qc.id AS query_id, r.id AS row_id, round(sum(qc.n * ln(1 + (docs - df + 0.5) / (df + 0.5)) * (r.n * 2.5 / (r.n + 1.5 * (1 - 0.75 + 0.75 * length / mean)))), 6) AS score
  FROM qc JOIN r USING (token) JOIN df USING (token) JOIN len ON len.id = r.id CROSS JOIN stats GROUP BY ALL)) WHERE rank <= 12)"""
_VEC = lambda rows, query: f"""WITH v AS ({rows}), h AS (SELECT a.row_id AS query_id, b.row_id, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM v a JOIN v b ON true WHERE {query})
SELECT query_id, row_id, score, rank FROM (SELECT *, {_RANK} AS rank FROM h WHERE score > 0) WHERE rank <= 12"""  # noqa: E731

_HYBRID = f"""WITH v AS (SELECT DISTINCT stable_chunk_uid AS id, CAST(dense AS DOUBLE[]) AS x, sparse_indices AS si, sparse_values AS sv, CAST('0x' || substring(stable_chunk_uid, 1, 8) AS BIGINT) % 100 = 0 AS asks FROM section_vectors WHERE stable_chunk_uid IS NOT NULL),
dv AS (SELECT DISTINCT id, x, asks FROM v WHERE len(x) = 64 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
dh AS (SELECT a.id AS query_id, b.id AS row_id, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM dv a JOIN dv b ON a.asks),
d AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM dh WHERE score > 0) WHERE rank <= 32),
sp AS (SELECT id, asks, si, sv, unnest(si) AS t, CAST(unnest(sv) AS DOUBLE) AS w FROM v),
sw AS (SELECT id, asks, t, sum(w) AS w FROM sp WHERE t IS NOT NULL AND w IS NOT NULL AND isfinite(w) GROUP BY id, asks, si, sv, t HAVING sum(w) <> 0),
sh AS (SELECT a.id AS query_id, b.id AS row_id, round(sum(a.w * b.w), 6) AS score FROM sw a JOIN sw b ON a.asks AND a.t = b.t GROUP BY ALL),
s AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM sh WHERE score > 0) WHERE rank <= 32),
f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.row_id, s.row_id) AS row_id, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS score,
  d.rank AS dense_rank, d.score AS dense_score, s.rank AS sparse_rank, s.score AS sparse_score FROM d FULL JOIN s ON d.query_id = s.query_id AND d.row_id = s.row_id),
hy AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM f) WHERE rank <= 17)"""

SQL = {
    "section_hybrid": f"{_HYBRID} SELECT * FROM hy",
    "section_dense_gate": f"""{_HYBRID} SELECT * FROM (SELECT * EXCLUDE (rank), {_RANK} AS rank FROM hy WHERE query_id <> row_id AND (dense_score IS NULL OR dense_score >= 0.55)) WHERE rank <= 8""",
    "sparse_search": f"WITH {_BASE}, {_SPARSE} SELECT * FROM sp",
    "bm25_search": f"WITH {_BASE}, {_BM25} SELECT * FROM bm",
    "hybrid_search": f"""WITH {_BASE}, {_SPARSE}, {_BM25},
f AS (SELECT coalesce(sp.query_id, bm.query_id) AS query_id, coalesce(sp.row_id, bm.row_id) AS row_id, round(coalesce(1.0 / (60 + sp.rank), 0) + coalesce(1.0 / (60 + bm.rank), 0), 9) AS score,
  sp.rank AS sparse_rank, sp.score AS sparse_score, bm.rank AS bm25_rank, bm.score AS bm25_score FROM sp FULL JOIN bm ON sp.query_id = bm.query_id AND sp.row_id = bm.row_id)
SELECT * FROM (SELECT *, {_RANK} AS rank FROM f) WHERE rank <= 8""",
    "dense_search": _VEC("SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings", "a.row_id % 100 = 0"),
    "section_vector_search": _VEC(
        "SELECT DISTINCT stable_chunk_uid AS row_id, CAST(dense AS DOUBLE[]) AS x FROM section_vectors WHERE len(dense) = 64 AND len(list_filter(dense, lambda e: e IS NULL OR isnan(e))) = 0 AND len(list_filter(dense, lambda e: e <> 0)) > 0",
        "CAST('0x' || substring(a.row_id, 1, 8) AS BIGINT) % 100 = 0",
    ),
    "candidate_similarity": """WITH v AS (SELECT source_section_id, arg_min(CAST(dense AS DOUBLE[]), stable_chunk_uid) AS x FROM section_vectors WHERE len(dense) = 64 GROUP BY 1),
c AS (SELECT DISTINCT source_section_id, target_section_id FROM related_section_candidates WHERE source_section_id IS NOT NULL AND target_section_id IS NOT NULL),
p AS (SELECT c.*, a.x AS a, b.x AS b FROM c LEFT JOIN v a ON a.source_section_id = c.source_section_id LEFT JOIN v b ON b.source_section_id = c.target_section_id),
z AS (SELECT source_section_id, target_section_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN list_dot_product(a, a) * list_dot_product(b, b) = 0 THEN 0.0 ELSE list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) END AS x FROM p)
SELECT source_section_id, target_section_id, CASE WHEN NOT isnan(x) THEN round(x, 5) END AS cosine FROM z""",
}
