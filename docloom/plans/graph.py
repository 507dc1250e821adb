"""Queries on graphs, events, rules, chunks and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunks as C
from docloom.operators import events as E
from docloom.operators import graph as G
from docloom.operators import rules as R
from docloom.sources.tables import table
from docloom.streaming import changes as X

_C = F.col


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "related_section_candidates").where("trim(source_section_id) <> '' AND trim(target_section_id) <> ''")
    return rows.select(_C("source_section_id").alias("src"), _C("target_section_id").alias("dst"), _C("candidate_score").alias("weight"))


def _exact_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "related_section_candidates").where("arrays_overlap(channels, array('markdown_link', 'shared_identifier')) AND trim(source_section_id) <> '' AND trim(target_section_id) <> ''")
    return rows.select(_C("source_section_id").alias("src"), _C("target_section_id").alias("dst"), F.coalesce("candidate_score", F.lit(1.0)).alias("weight"))


def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "conflict_review_items").select(_C("section_pair.left_section_id").alias("node")).where("trim(node) <> ''")
    return G.bounded_bfs(_edges(spark, d), seeds, 2)


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over the edges of exact channels, a link or a shared identifier; so are their sizes and the labels."""
    return G.components(_exact_edges(spark, d))


def graph_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph_components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def graph_labels(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(_exact_edges(spark, d))


def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.short_cycles(_edges(spark, d))


def graph_cycles_4(spark: SparkSession, d: str) -> DataFrame:
    """All cycles of up to four candidate edges."""
    return G.bounded_cycles(_edges(spark, d), 4)


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


def change_queue(spark: SparkSession, d: str) -> DataFrame:
    return E.change_queue(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


def change_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.quiet_sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")


def change_expiry(spark: SparkSession, d: str) -> DataFrame:
    return E.expired(table(spark, d, "events"), "user_id", "ts", "12 HOURS")


def label_accumulation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "work_items").select("section_id", "prepared_at", F.explode("identifiers").alias("label")).select("section_id", "prepared_at", F.trim("label").alias("label")).where("label <> ''")
    return E.accumulate(rows, "label", "prepared_at", "section_id")


def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    return E.transitions(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of the event stream that ended two days before its last event or earlier, late rows included."""
    windows = _windows(spark, d)
    last = windows.agg(F.max("last").alias("newest"))
    return windows.join(F.broadcast(last), F.expr("start + INTERVAL 1 DAY <= newest - INTERVAL 2 DAYS")).select("start", "event_type", "n", "total")


def stream_windows_all(spark: SparkSession, d: str) -> DataFrame:
    """All daily windows of the event stream, the last ones too."""
    return _windows(spark, d).select("start", "event_type", "n", "total")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return X.whole_windows(X.stream_table(spark, d, "events"), "ts", "event_type", "windows").withColumns({c: _C(c).cast("timestamp_ntz") for c in ("start", "last")})


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    stream = X.stream_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return X.latest_by_key(stream, "user_id", ["ts", "event_id"], "latest")


def _live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("section_id IS NOT NULL").select("section_id", "source_document_id", _C("source_span.start_line").alias("start_line"), "text").distinct()


def modal_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return R.modal_conflicts(_live(spark, d), "source_document_id", "start_line", "section_id")


def numeric_bounds(spark: SparkSession, d: str) -> DataFrame:
    return R.numeric_bounds(_live(spark, d), "source_document_id")


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_sections(_live(spark, d))


QUERIES = {
    f.__name__: f
    for f in (graph_bfs, graph_components, graph_component_sizes, graph_labels, graph_cycles, graph_cycles_4, graph_degrees, change_queue, change_sessions, change_expiry, label_accumulation, event_transitions, stream_windows, stream_windows_all, stream_latest, modal_conflicts, numeric_bounds, section_chunks)
}

_E = "e AS (SELECT source_section_id AS src, target_section_id AS dst FROM related_section_candidates WHERE trim(source_section_id, ' ') <> '' AND trim(target_section_id, ' ') <> '')"
_U = f"{_E}, u AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"
_S = "s AS (SELECT DISTINCT section_id, source_document_id, source_span.start_line AS start_line, text FROM sections WHERE section_id IS NOT NULL)"

_X = "x AS (SELECT source_section_id AS src, target_section_id AS dst, coalesce(candidate_score, 1.0) AS w FROM related_section_candidates WHERE (list_contains(channels, 'markdown_link') OR list_contains(channels, 'shared_identifier')) AND trim(source_section_id, ' ') <> '' AND trim(target_section_id, ' ') <> '')"
_COMPONENTS = f"""WITH RECURSIVE {_X}, u AS (SELECT src, dst FROM x UNION SELECT dst, src FROM x),
walk AS (SELECT src AS node, src AS label FROM u UNION SELECT u.dst, walk.label FROM walk JOIN u ON u.src = walk.node WHERE walk.label < u.dst), c AS (SELECT node, min(label) AS component FROM walk GROUP BY node)"""
_ROUND = """v{n} AS (SELECT u.src, l.label, round(sum(u.w), 6) AS votes FROM u JOIN l{m} l ON u.dst = l.node GROUP BY ALL),
l{n} AS (SELECT src AS node, label FROM (SELECT v.src, v.label, row_number() OVER (PARTITION BY v.src ORDER BY votes DESC, CAST(v.label = mine.label AS INTEGER) DESC, v.label) AS place FROM v{n} v JOIN l{m} mine ON mine.node = v.src) WHERE place = 1)"""

SQL = {
    "graph_component_sizes": f"{_COMPONENTS} SELECT component, count(*) AS nodes FROM c GROUP BY component",
    "graph_labels": f"""WITH {_X}, u AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM x WHERE src <> dst UNION ALL SELECT dst, src, w FROM x WHERE src <> dst) GROUP BY src, dst),
l0 AS (SELECT DISTINCT src AS node, src AS label FROM u), {", ".join(_ROUND.format(n=n, m=n - 1) for n in range(1, 5))} SELECT node, label FROM l4""",
    "graph_bfs": f"""WITH {_U}, h0 AS (SELECT DISTINCT section_pair.left_section_id AS node FROM conflict_review_items WHERE trim(section_pair.left_section_id, ' ') <> ''),
h1 AS (SELECT DISTINCT dst AS node FROM h0 JOIN u ON node = src WHERE dst NOT IN (SELECT node FROM h0)), h2 AS (SELECT DISTINCT dst AS node FROM h1 JOIN u ON node = src WHERE dst NOT IN (SELECT node FROM h0) AND dst NOT IN (SELECT node FROM h1))
SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
    "graph_cycles": f"WITH {_E} SELECT DISTINCT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst",
    "graph_cycles_4": f"""WITH RECURSIVE {_E}, d AS (SELECT DISTINCT src, dst FROM e),
p AS (SELECT [src] AS nodes, dst AS next FROM d WHERE dst >= src
  UNION ALL SELECT list_append(nodes, next), d.dst FROM p JOIN d ON d.src = next WHERE next <> nodes[1] AND len(nodes) < 4 AND d.dst >= nodes[1] AND NOT list_contains(nodes, next))
SELECT nodes, CAST(len(nodes) AS INTEGER) AS length FROM p WHERE next = nodes[1]""",
    "graph_degrees": f"WITH {_E}, x AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM x UNION ALL SELECT dst, 0, 1 FROM x) GROUP BY node",
    "change_queue": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_change, max(ts) AS changed_at, count(*) AS changes FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "change_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM k GROUP BY user_id, session""",
    "change_expiry": "SELECT user_id, max(ts) AS last, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR AS idle FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "label_accumulation": "SELECT label, min(prepared_at) AS first_seen, max(prepared_at) AS last_seen, count(DISTINCT section_id) AS supporters FROM (SELECT section_id, prepared_at, trim(unnest(identifiers), ' ') AS label FROM work_items) WHERE label <> '' GROUP BY label",
    "event_transitions": "SELECT from_state, to_state, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events WHERE user_id IS NOT NULL) WHERE from_state IS NOT NULL AND to_state IS NOT NULL GROUP BY ALL",
    "stream_windows": """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 DAY, max(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""",
    "stream_windows_all": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "stream_latest": "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "modal_conflicts": f"""WITH {_S}, m AS (SELECT source_document_id, arg_min(section_id, (start_line, section_id)) FILTER (regexp_matches(regexp_replace(text, '{R._NEGATED}', ' ', 'g'), '{R.REQUIRED}')) AS required_in,
arg_min(section_id, (start_line, section_id)) FILTER (regexp_matches(text, '{R.PROHIBITED}')) AS prohibited_in FROM s WHERE source_document_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)
SELECT * FROM m WHERE required_in IS NOT NULL AND prohibited_in IS NOT NULL""",
    "numeric_bounds": f"""WITH {_S}, b AS (SELECT source_document_id, min(list_min(list_transform(regexp_extract_all(text, 'not exceed ([0-9]+)', 1), lambda e: coalesce(TRY_CAST(e AS BIGINT), 9223372036854775807)))) AS lowest_limit,
max(list_max(list_transform(regexp_extract_all(text, 'wait ([0-9]+)', 1), lambda e: coalesce(TRY_CAST(e AS BIGINT), 9223372036854775807)))) AS highest_wait FROM s WHERE source_document_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)
SELECT *, highest_wait > lowest_limit AS conflict FROM b WHERE lowest_limit IS NOT NULL AND highest_wait IS NOT NULL""",
    "graph_components": f"{_COMPONENTS} SELECT node, component FROM c",
}
