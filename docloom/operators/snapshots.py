"""What changed between consecutive full snapshots of a table.

Gaps and islands over (key, hashes): the rows of a key in snapshot order fall
into islands of consecutive snapshots without a change. An island is a validity
interval. Interval starts become ``added`` (after a gap) or a change, interval
ends before the last snapshot become ``removed`` (before a gap).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(snapshots: DataFrame, key: str, snapshot: str, delivered: str, hashes: tuple[str, str]) -> DataFrame:
    """One (key, no, source, semantic) per key and snapshot: the row delivered last.

    ``max`` of a struct combines before the shuffle, so a key redelivered
    without end never meets in one task. Equal delivery times are decided by the
    larger hashes. Hashes are lower-cased; null keys and snapshots are ignored.
    """
    source, semantic = hashes
    return (
        snapshots.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
        .groupBy(F.col(key).alias("key"), F.col(snapshot).alias("no"))
        .agg(F.max(F.struct(F.col(delivered).alias("d"), F.lower(source).alias("source"), F.lower(semantic).alias("semantic"))).alias("v"))
        .select("key", "no", "v.source", "v.semantic")
    )


def _positions(rows: DataFrame, snapshot: str) -> DataFrame:
    """(no, ord, next_no): the snapshots in order; as many rows as there are snapshots."""
    w = Window.partitionBy(F.lit(1)).orderBy("no")
    numbers = rows.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("no")).distinct()
    return numbers.select("no", F.row_number().over(w).alias("ord"), F.lead("no").over(w).alias("next_no"))


def validity_intervals(
    snapshots: DataFrame,
    key: str = "section_id",
    snapshot: str = "snapshot_no",
    delivered: str = "delivered_at",
    hashes: tuple[str, str] = ("source_hash", "semantic_hash"),
) -> DataFrame:
    """(key, first_no, last_no, opened_by, gone_at, source, semantic) per island.

    ``opened_by``: ``added`` after a gap, ``changed`` or ``reformatted`` when
    the row before is in the snapshot before and differs. A pair of hashes is
    compared only if both are there: ``changed`` if the semantic hash differs,
    or cannot be compared while the source hash differs; ``reformatted`` if the
    semantic hash is equal and the source hash differs. ``gone_at``: the
    snapshot in which the key is first missing after the island, else null.
    ``snapshot`` numbers need not be dense: consecutive means consecutive among
    those that were delivered.
    """
    rows = latest_rows(snapshots, key, snapshot, delivered, hashes).join(F.broadcast(_positions(snapshots, snapshot)), "no")
    by_key = Window.partitionBy("key").orderBy("ord")
    prev = lambda c: F.lag(c).over(by_key)
    rows = rows.select(
        "key", "no", "ord", "next_no", "source", "semantic",
        prev("ord").alias("p_ord"), prev("source").alias("p_source"), prev("semantic").alias("p_semantic"), F.lead("ord").over(by_key).alias("n_ord"),
    )
    both = F.col("semantic").isNotNull() & F.col("p_semantic").isNotNull()
    source_differs = F.coalesce(F.col("source") != F.col("p_source"), F.lit(False))
    kind = (
        F.when(F.col("p_ord").isNull() | (F.col("p_ord") != F.col("ord") - 1), "added")
        .when(both & (F.col("semantic") != F.col("p_semantic")), "changed")
        .when(~both & source_differs, "changed")
        .when(both & source_differs, "reformatted")
    )
    islands = rows.withColumn("kind", kind).withColumn("island", F.count("kind").over(by_key))
    return islands.groupBy("key", "island").agg(
        F.min(F.struct("ord", "no")).getField("no").alias("first_no"),
        F.max(F.struct("ord", "no")).getField("no").alias("last_no"),
        F.max("kind").alias("opened_by"),
        F.max(F.when(F.col("n_ord").isNull() | (F.col("n_ord") != F.col("ord") + 1), F.col("next_no"))).alias("gone_at"),
        F.max(F.struct("ord", "source")).getField("source").alias("source"),
        F.max(F.struct("ord", "semantic")).getField("semantic").alias("semantic"),
    )


def change_events(intervals: DataFrame, snapshots: DataFrame, key: str = "section_id", snapshot: str = "snapshot_no") -> DataFrame:
    """(snapshot_no, key, change_kind) from interval starts and ends.

    The first snapshot has nothing before it and gives no event.
    """
    first = snapshots.agg(F.min(snapshot).alias("lowest"))
    started = F.when(F.col("first_no") > F.col("lowest"), F.struct(F.col("first_no").alias("no"), F.col("opened_by").alias("kind")))
    ended = F.when(F.col("gone_at").isNotNull(), F.struct(F.col("gone_at").alias("no"), F.lit("removed").alias("kind")))
    events = intervals.join(F.broadcast(first), F.lit(True)).select("key", F.explode(F.array_compact(F.array(started, ended))).alias("e"))
    return events.select(F.col("e.no").alias(snapshot), F.col("key").alias(key), F.col("e.kind").alias("change_kind"))


def snapshot_changes(snapshots: DataFrame, **names) -> DataFrame:
    """Added, removed, changed and reformatted keys between consecutive snapshots.

    An empty table and a single snapshot give no rows.
    """
    key, snapshot = names.get("key", "section_id"), names.get("snapshot", "snapshot_no")
    return change_events(validity_intervals(snapshots, **names), snapshots, key, snapshot)
