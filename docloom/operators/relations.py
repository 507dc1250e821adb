"""Relations between keyed records: validation, inheritance, coverage and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.store import drifted
from docloom.session import cut_lineage


def validate_targets(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """(candidate_id, verdict): kept, or the first reason against it: blank_source, blank_target, self, unknown_source, unknown_target.

    ``live`` has one ``section_id`` per existing section; both lookups are joins
    on the id.
    """
    known = live.where("section_id IS NOT NULL").select("section_id").distinct()
    side = lambda name: known.select(F.col("section_id").alias(f"{name}_section_id"), F.lit(True).alias(f"{name}_known"))
    rows = candidates.select("candidate_id", "source_section_id", "target_section_id").distinct()
    rows = rows.join(side("source"), "source_section_id", "left").join(side("target"), "target_section_id", "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    verdict = (
        F.when(blank("source_section_id"), "blank_source").when(blank("target_section_id"), "blank_target").when(F.col("source_section_id") == F.col("target_section_id"), "self")
        .when(F.col("source_known").isNull(), "unknown_source").when(F.col("target_known").isNull(), "unknown_target").otherwise("kept")
    )
    return rows.select("candidate_id", verdict.alias("verdict"))


def inherit(previous: DataFrame, recomputed: DataFrame, changed: DataFrame, live: DataFrame) -> DataFrame:
    """(src, dst, origin): relations of changed sources from ``recomputed``, of the others from ``previous`` where the target still exists."""
    kept = previous.select("src", "dst").distinct().join(changed.select(F.col("key").alias("src")).distinct(), "src", "left_anti")
    kept = kept.join(live.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", F.lit("inherited").alias("origin"))
    new = recomputed.select("src", "dst").distinct().join(changed.select(F.col("key").alias("src")).distinct(), "src", "left_semi")
    return kept.unionByName(new.select("src", "dst", F.lit("recomputed").alias("origin")))


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value of every group; ties go to the smaller value."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    counts = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def coverage_level(covered: Column, total: Column) -> Column:
    """high from three quarters on, medium above none, else low."""
    share = covered / total
    return F.when(share >= 0.75, "high").when(share > 0, "medium").otherwise("low")


def coverage(members: DataFrame, covered: DataFrame, group: str, key: str) -> DataFrame:
    """(group, members, covered, level): how many keys of each group occur in ``covered``."""
    there = covered.where(F.col(key).isNotNull()).select(key, F.lit(1).alias("_there")).distinct()
    rows = members.where(F.col(group).isNotNull()).select(group, key).distinct().join(there, key, "left")
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count("_there").alias("covered"))
    return counts.withColumn("level", coverage_level(F.col("covered"), F.col("members")))


def reconcile(before: DataFrame, after: DataFrame, key: str, uid: str, source: str, semantic: str) -> DataFrame:
    """(old_key, new_key, state) of two manifests: unchanged, format_only, changed, renamed, added or removed.

    Rows meet by key; what is left meets by an identity that is unique on both
    sides (renamed). A missing hash says nothing about a change.
    """
    a = before.select(F.col(key).alias("old_key"), F.col(uid).alias("a_uid"), F.col(source).alias("a_source"), F.col(semantic).alias("a_semantic"))
    b = after.select(F.col(key).alias("new_key"), F.col(uid).alias("b_uid"), F.col(source).alias("b_source"), F.col(semantic).alias("b_semantic"))
    both = a.join(b, a["old_key"] == b["new_key"], "full")
    state = F.when(drifted(F.col("b_semantic"), F.col("a_semantic")), "changed").when(drifted(F.col("b_source"), F.col("a_source")), "format_only").otherwise("unchanged")
    met = both.where("old_key IS NOT NULL AND new_key IS NOT NULL").select("old_key", "new_key", state.alias("state"))
    lone = both.where("old_key IS NULL OR new_key IS NULL").withColumn("uid", F.coalesce("a_uid", "b_uid"))
    n = lambda c: F.count(c)
    unique = lone.where("uid IS NOT NULL").groupBy("uid").agg(n("old_key").alias("x"), n("new_key").alias("y"), F.min("old_key").alias("old_key"), F.min("new_key").alias("new_key")).where("x = 1 AND y = 1")
    moved = unique.select("old_key", "new_key", F.lit("renamed").alias("state"))
    used = unique.select(F.explode(F.array("old_key", "new_key")).alias("k"))
    alone = lone.select("old_key", "new_key", F.coalesce("old_key", "new_key").alias("k")).join(used, "k", "left_anti")
    rest = alone.select("old_key", "new_key", F.when(F.col("old_key").isNull(), "added").otherwise("removed").alias("state"))
    return met.unionByName(moved).unionByName(rest)


def cache_probe(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``hit``: whether their cache key is stored; misses are what has to be computed."""
    stored = cache.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("hit")).distinct()
    return keys.join(stored, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Numbers the rows of every group in batches of ``size``, in the order of ``order``.

    Rows are range-partitioned by group and order, so a group of any size is
    spread over many slices; a row's number is its place in its slice, plus what
    the slices before hold of its group. Of that there is a row per slice and
    group. The sorted rows are cut off from their lineage, so that both reads
    see the same slices. Rows that are equal in ``order`` keep no fixed order.
    """
    key = [group, *order]
    sliced = cut_lineage(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_slice", F.spark_partition_id()))
    counts = sliced.groupBy("_slice", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", F.col(group).alias("_group"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_slice", group).orderBy(*order))
    numbered = sliced.withColumn("_place", place)
    joined = numbered.join(offsets, (numbered["_slice"] == offsets["_slice"]) & numbered[group].eqNullSafe(offsets["_group"]))
    return joined.withColumn("batch", F.floor((F.col("_before") + F.col("_place") - 1) / size).cast("long")).select(*rows.columns, "batch")
