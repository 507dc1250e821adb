"""Top-k search: dense, sparse, BM25, and their fusion by reciprocal ranks.

Queries are a stated set; rows are a table of any size. Scores are computed
where the rows are: a task multiplies its rows, in Arrow batches, with the
matrix of the queries, and keeps the k best rows of every query, which are all
that is shuffled. Queries are broadcast only in groups of bounded size; a larger
set is searched in several passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors in one pass, and queries with terms in one pass.
QUERY_ROWS, TERM_QUERIES = 20_000, 2_000
#: Cells of the matrix of rows by query terms that is multiplied at once.
CELLS = 4_000_000


def top_k(hits: DataFrame, k: int, query: str = "query_id", row: str = "row_id", score: str = "score") -> DataFrame:
    """The k best rows of every query with their rank; ties go to the smaller row. k <= 0 gives none.

    The filter on the row number lets Spark limit every map task before the shuffle.
    """
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(row))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, k))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x)


class _Best:
    """The k best (score, row) of every query of a task; ties go to the smaller row."""

    def __init__(self, k: int, queries: int, kind: pa.DataType):
        self.k, self.kind = k, kind
        self.bar = np.zeros(queries)  # a row must be above zero, and reach the k-th best so far
        self.query, self.row, self.score = np.zeros(0, dtype=np.int64), pa.array([], kind), np.zeros(0)

    def add(self, scores: np.ndarray, rows: pa.Array) -> None:
        """``scores[i, j]``: of query i and rows[j]."""
        i, j = np.nonzero((scores > 0) & (scores >= self.bar[:, None]))
        if not len(i):
            return
        if len(i) > 4 * self.k * len(self.bar):  # of many rows first the k-th best of each query
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k] if self.k < scores.shape[1] else self.bar
            i, j = np.nonzero((scores > 0) & (scores >= np.maximum(self.bar, least)[:, None]))
        query, score = np.concatenate((self.query, i)), np.concatenate((self.score, scores[i, j]))
        row = pa.concat_arrays([self.row, rows.take(pa.array(j))])
        order = np.asarray(pc.sort_indices(pa.table({"q": query, "s": score, "r": row}), sort_keys=[("q", "ascending"), ("s", "descending"), ("r", "ascending")]))
        query = query[order]
        first = np.searchsorted(query, np.arange(len(self.bar)))
        keep = np.arange(len(query)) - first[query] < self.k
        order = order[keep]
        self.query, self.score, self.row = query[keep], score[order], row.take(pa.array(order))
        count = np.bincount(self.query, minlength=len(self.bar))
        full = np.flatnonzero(count == self.k)
        self.bar[full] = self.score[np.cumsum(count)[full] - 1]

    def hits(self, names: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.take(pa.array(self.query)), self.row, pa.array(self.score)], names=["query_id", "row_id", "score"])


def _passes(queries: DataFrame, size: int) -> Iterator[pa.Table]:
    """The rows of ``queries`` in groups of about ``size`` query_ids, chosen by hash."""
    groups = max(1, -(-queries.select("query_id").distinct().count() // size))
    for g in range(groups):
        yield (queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)).toArrow()


def fitting(vectors: DataFrame, dim: int) -> Column:
    """Whether ``x`` is a vector of ``dim`` numbers. The others neither ask nor are found; select by its negation to see them."""
    return F.coalesce((F.size("x") == dim) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)), F.lit(False))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int, digits: int = 6) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows of highest positive cosine.

    ``vectors`` has (row_id, x), ``queries`` (query_id, x). Vectors that are not
    ``fitting`` are no hits and have none; a zero vector has cosine 0. Scores
    are rounded before they are ranked, so ties are ties everywhere.
    """
    kind = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["row_id"]
    unit = lambda x: np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
    matrix = lambda column: np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    asking = queries.where(F.col("query_id").isNotNull() & fitting(queries, dim)).select("query_id", "x").distinct()
    fit = vectors.where(fitting(vectors, dim)).select("row_id", "x")
    out = None
    for table in _passes(asking, QUERY_ROWS):
        shared = vectors.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), unit(matrix(table.column(1).combine_chunks()))))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = None
            for b in batches:
                best = best or _Best(k, len(q), b.column(0).type)
                for s in range(0, b.num_rows if len(q) and k > 0 else 0, 4096):
                    rows = b.slice(s, 4096)
                    best.add(_rounded(q @ unit(matrix(rows.column(1))).T, digits), rows.column(0))
            if best:
                yield best.hits(names)

        hits = fit.mapInArrow(search, f"query_id {kind[0]}, row_id {kind[1]}, score double")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, k)


def term_top_k(rows: DataFrame, queries: DataFrame, k: int, saturate: tuple[float, float, float] | None = None, digits: int = 6) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows of highest positive sum of products over shared terms.

    ``rows`` has (row_id, terms, weights), two arrays of one length, or
    (row_id, terms), where each term counts as often as it occurs; ``queries``
    has (query_id, term, weight), one row per query and term. With
    ``saturate`` (k1, b, mean) a count n in a row of m terms weighs
    n (k1 + 1) / (n + k1 (1 - b + b m / mean)). Scores are rounded before they
    are ranked. Null rows and terms have no score.
    """
    out = None
    for table in _passes(queries.where("query_id IS NOT NULL AND term IS NOT NULL"), TERM_QUERIES):
        names, terms = (table.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
        hits = _term_hits(rows, dict(queries.dtypes)["query_id"], names, terms, table.column(2).to_numpy(), k, saturate, digits)
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, k)


def _term_hits(rows: DataFrame, kind: str, names: pa.DictionaryArray, terms: pa.DictionaryArray, weights: np.ndarray, k: int, saturate: tuple[float, float, float] | None, digits: int) -> DataFrame:
    """(query_id, row_id, score): the k best rows of every query in every task, for one pass of queries."""
    weighted = "weights" in rows.columns
    # no filter on the terms here: it would compute them a second time
    columns = rows.where("row_id IS NOT NULL").select("row_id", "terms", *(["weights"] if weighted else []))
    at = np.asarray(terms.indices, dtype=np.int64), np.asarray(names.indices, dtype=np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((names.dictionary, terms.dictionary, at, np.asarray(weights, dtype=np.float64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, (t, q), w = shared.value
        asked = np.zeros((len(terms), len(names)))
        np.add.at(asked, (t, q), w)
        best, step = None, max(1, CELLS // max(1, len(terms)))
        for b in batches:
            best = best or _Best(k, len(names), b.column(0).type)
            for s in range(0, b.num_rows if len(names) and k > 0 else 0, step):
                part = b.slice(s, step)
                lists = part.column(1)
                code = _codes(lists, terms)
                lengths = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                value = np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)[code >= 0] if weighted else None
                owner, code = owner[code >= 0], code[code >= 0]
                n = np.bincount(owner * len(terms) + code, value, minlength=len(lengths) * len(terms)).reshape(len(lengths), len(terms))
                if saturate:
                    k1, fade, mean = saturate
                    n = n * (k1 + 1) / (n + k1 * (1 - fade + fade * lengths[:, None] / mean))
                best.add(_rounded((n @ asked).T, digits), part.column(0))
        if best:
            yield best.hits(names)

    return columns.mapInArrow(search, f"query_id {kind}, row_id {dict(rows.dtypes)['row_id']}, score double")


def _codes(lists: pa.ListArray, terms: pa.Array) -> np.ndarray:
    """The place in ``terms`` of every list element, -1 for those that are not there."""
    return pc.index_in(lists.flatten(), terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def term_counts(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, token, n): how often each term occurs in each row."""
    return rows.select(key, F.explode(terms).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def capped_terms(counts: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` most frequent terms of every query; ties by term."""
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "token")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).drop("place")


def _statistics(rows: DataFrame, terms: pa.Array) -> tuple[int, float, np.ndarray]:
    """(rows with terms, their mean length, in how many rows each of ``terms`` occurs): one line per task and term is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms) + 2, dtype=np.int64)
        for b in batches:
            lengths = np.asarray(b.column(0).value_lengths().fill_null(0), dtype=np.int64)
            code = _codes(b.column(0), terms)
            pairs = np.unique(np.repeat(np.arange(len(lengths)), lengths)[code >= 0] * len(terms) + code[code >= 0])
            total[:-2] += np.bincount(pairs % max(1, len(terms)), minlength=len(terms))
            total[-2:] += (int((lengths > 0).sum()), int(lengths.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

    summed = np.zeros(len(terms) + 2, dtype=np.int64)
    for r in rows.select("terms").mapInArrow(count, "i long, n long").where("n > 0").groupBy("i").agg(F.sum("n").alias("n")).collect():
        summed[r.i] = r.n
    return int(summed[-2]), summed[-1] / max(1, summed[-2]), summed[:-2]


def bm25_top_k(rows: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(query_id, row_id, score, rank) from (row_id, terms) and (query_id, token, n).

    idf is ln(1 + (N - df + .5) / (df + .5)). Number and mean length of the rows
    that have terms, and the document frequencies of the asked terms, are
    counted where the rows are; no row's terms are shuffled.
    """
    out = None
    for table in _passes(queries.where("query_id IS NOT NULL AND token IS NOT NULL").select("query_id", "token", "n"), TERM_QUERIES):
        names, terms = (table.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
        docs, mean, df = _statistics(rows, terms.dictionary)
        idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
        weights = table.column(2).to_numpy() * idf[np.asarray(terms.indices, dtype=np.int64)]
        hits = _term_hits(rows, dict(queries.dtypes)["query_id"], names, terms, weights, k, (k1, b, mean or 1.0), digits)
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, k)


def fuse(channels: dict[str, DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked channels, with each channel's rank and score beside it (null: not found there)."""
    merged = None
    for name, hits in channels.items():
        own = hits.select("query_id", "row_id", F.lit(name).alias("channel"), "rank", "score")
        merged = own if merged is None else merged.unionByName(own)
    pick = lambda c, n: F.max(F.when(F.col("channel") == n, F.col(c))).alias(f"{n}_{c}")
    fused = merged.groupBy("query_id", "row_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), *[pick(c, n) for n in channels for c in ("rank", "score")])
    return top_k(fused, k)


def dense_gate(fused: DataFrame, least: float, k: int) -> DataFrame:
    """The first ``k`` hits of every query whose dense score reaches ``least``; a hit the dense channel did not find is not gated.

    Hits of a query with itself are left out before they are counted.
    """
    other = fused.where("query_id <> row_id").where(F.col("dense_score").isNull() | (F.col("dense_score") >= least))
    return top_k(other.drop("rank"), k)
