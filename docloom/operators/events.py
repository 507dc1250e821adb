"""Keyed change events: queues, sessions, expiry and accumulation, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_queue(events: DataFrame, key: str, at: str, order: str, change: str) -> DataFrame:
    """One entry per key: the last change and how many there were; equal times are decided by ``order``."""
    last = F.max_by(F.col(change), F.struct(at, order))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("last_change"), F.max(at).alias("changed_at"), F.count(F.lit(1)).alias("changes"))


def quiet_sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, first, last, events) of bursts that end when nothing came for longer than ``gap``: the debounce of a change queue."""
    sessions = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, F.session_window(at, gap).alias("w"))
    return sessions.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("events")).drop("w")


def expired(events: DataFrame, key: str, at: str, ttl: str) -> DataFrame:
    """(key, last, idle): whether each key's last event is more than ``ttl`` before the newest event of all."""
    newest = events.agg(F.max(at).alias("now"))
    last = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(at).alias("last"))
    return last.join(F.broadcast(newest), F.lit(True)).select(key, "last", (F.col("last") < F.col("now") - F.expr(f"INTERVAL {ttl}")).alias("idle"))


def accumulate(events: DataFrame, label: str, at: str, supporter: str) -> DataFrame:
    """(label, first_seen, last_seen, supporters): how long and by how many each label was seen."""
    return events.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.countDistinct(supporter).alias("supporters"))


def transitions(events: DataFrame, key: str, at: str, order: str, state: str) -> DataFrame:
    """(from_state, to_state, n): how often one state directly follows another of the same key."""
    w = Window.partitionBy(key).orderBy(at, order)
    rows = events.where(F.col(key).isNotNull()).select(F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state"))
    return rows.where("from_state IS NOT NULL AND to_state IS NOT NULL").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
