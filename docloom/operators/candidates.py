"""Related-section candidates: merging channels, scoring, limits and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each channel, strongest first (fixed values).
CHANNEL_WEIGHTS = {"markdown_link": 100.0, "shared_identifier": 90.0, "search_key_match": 80.0, "qdrant_section_hybrid": 60.0}
EXACT_CHANNELS = ("markdown_link", "shared_identifier")


def channel_weight(channel: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CHANNEL_WEIGHTS.items() for x in kv])[channel], F.lit(0.0))


def merge_channels(candidates: DataFrame) -> DataFrame:
    """One row per (source, target) with all channels and distinct evidence terms, and the score of both.

    Score: the strongest channel, plus one per further channel up to five, plus
    a quarter per evidence term up to three. Pairs with a null or blank id, or
    of a section with itself, are left out. Channels and terms are aggregated as
    distinct rows, so a pair found without end is not one growing list.
    """
    ids = ("source_section_id", "target_section_id")
    named = candidates.where(F.trim(ids[0]).isNotNull() & (F.trim(ids[0]) != "") & (F.trim(ids[1]) != "") & (F.col(ids[0]) != F.col(ids[1])))
    facts = named.select(
        *ids,
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("pair").alias("kind"), F.lit("").alias("value"))),
                F.transform(F.coalesce("channels", F.array().cast("array<string>")), lambda c: F.struct(F.lit("channel").alias("kind"), c.alias("value"))),
                F.transform(F.coalesce("evidence_terms", F.array().cast("array<string>")), lambda c: F.struct(F.lit("term").alias("kind"), c.alias("value"))),
            )
        ).alias("f"),
    ).select(*ids, "f.kind", "f.value")
    facts = facts.where("value IS NOT NULL").distinct()
    channel, term = F.col("kind") == "channel", F.col("kind") == "term"
    merged = facts.groupBy(*ids).agg(
        F.array_sort(F.collect_list(F.when(channel, F.col("value")))).alias("channels"),
        F.max(F.when(channel, channel_weight(F.col("value")))).alias("best"),
        F.count(F.when(channel, 1)).alias("n_channels"),
        F.count(F.when(term & (F.trim("value") != ""), 1)).alias("n_terms"),
        F.coalesce(F.bool_or(channel & F.col("value").isin(*EXACT_CHANNELS)), F.lit(False)).alias("exact"),
    )
    score = F.coalesce("best", F.lit(0.0)) + F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col("n_channels") - 1.0)) + F.least(F.lit(3.0), F.col("n_terms") * 0.25)
    return merged.select(*ids, "channels", "n_terms", "exact", F.coalesce("best", F.lit(0.0)).alias("best"), F.round(score, 6).alias("score"))


def _strength() -> Window:
    semantic = F.array_contains("channels", "qdrant_section_hybrid")
    return Window.partitionBy("source_section_id").orderBy(F.desc(F.col("exact").cast("int")), F.desc("best"), F.desc("score"), F.desc(semantic.cast("int")), "target_section_id")


def limit_per_source(merged: DataFrame, limit: int = 32) -> DataFrame:
    """The ``limit`` strongest candidates of every source: exact channels first, then weight, score, and the target id."""
    return merged.withColumn("place", F.row_number().over(_strength())).where(F.col("place") <= limit)


def dropped_report(merged: DataFrame, limit: int = 32) -> DataFrame:
    """(source, kept, dropped) for sources with more than ``limit`` candidates, from counts alone."""
    n = merged.groupBy("source_section_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > limit).select("source_section_id", F.lit(limit).cast("long").alias("kept"), (F.col("n") - limit).alias("dropped"))


def gate(merged: DataFrame, threshold: float, cap: int) -> DataFrame:
    """Pairs that reach the threshold or have an exact channel; per source the first ``cap`` of them by score, and all exact ones."""
    w = Window.partitionBy("source_section_id").orderBy(F.desc("score"), "target_section_id")
    passed = merged.where((F.col("score") >= threshold) | F.col("exact"))
    return passed.withColumn("place", F.row_number().over(w)).where((F.col("place") <= cap) | F.col("exact"))


def unordered_pairs(candidates: DataFrame) -> DataFrame:
    """(left_id, right_id, pair_id, directions): candidates without direction, and a hash that names the pair."""
    a, b = F.col("source_section_id"), F.col("target_section_id")
    rows = candidates.where("trim(source_section_id) <> '' AND trim(target_section_id) <> ''").select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"), (a < b).alias("forward"))
    pairs = rows.groupBy("left_id", "right_id").agg(F.count_distinct("forward").alias("directions"))
    return pairs.select("left_id", "right_id", pair_id(F.col("left_id"), F.col("right_id")).alias("pair_id"), "directions")


def pair_id(left: Column, right: Column) -> Column:
    """A hash that names the unordered pair; ``left`` is the smaller id."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.concat(F.lit('["v1",['), quoted(left), F.lit(","), quoted(right), F.lit("]]"))
    return F.concat(F.lit("section_pair:sha256:v1:"), F.sha2(text, 256))


#: Which origin a pair keeps that has several (fixed values).
ORIGIN_PRECEDENCE = {"all_pairs": 0, "section_pair_retrieval": 1, "existing_conflict_recheck": 2}


def capped_union(pairs: DataFrame, exempt: list[tuple[DataFrame, str]], cap: int) -> DataFrame:
    """(left_id, right_id, pair_id, origin): the first ``cap`` of ``pairs`` by pair id, and all exempt ones.

    ``pairs`` has (left_id, right_id, origin), each exempt table (left_id,
    right_id) with its origin. A pair that is found twice keeps the origin of
    the higher precedence. A negative cap is none.
    """
    def named(df: DataFrame) -> DataFrame:
        ends = df.where("left_id IS NOT NULL AND right_id IS NOT NULL").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "origin")
        return ends.distinct().withColumn("pair_id", pair_id(F.col("left_id"), F.col("right_id")))

    rows = named(pairs)
    rows = rows if cap < 0 else rows.orderBy("pair_id").limit(cap)
    for df, origin in exempt:
        rows = rows.unionByName(named(df.withColumn("origin", F.lit(origin))))
    precedence = F.create_map(*[F.lit(x) for kv in ORIGIN_PRECEDENCE.items() for x in kv])[F.col("origin")]
    return rows.groupBy("left_id", "right_id", "pair_id").agg(F.max_by("origin", precedence).alias("origin"))


def with_fallback(selected: DataFrame, fallback: DataFrame, source: str) -> DataFrame:
    """The selected rows, and the fallback rows of the sources that have none selected, told apart by ``origin``."""
    rest = fallback.join(selected.select(source).distinct(), source, "left_anti")
    return selected.withColumn("origin", F.lit("selected")).unionByName(rest.withColumn("origin", F.lit("fallback")))


def owners(items: DataFrame, key: str, values: str, least: int = 2) -> DataFrame:
    """(value, owners, first_owner) of every list value with at least ``least`` owners.

    The factored form of a self-join on shared values: a group of n owners is one
    row here and n rows in ``memberships``, never n² pairs.
    """
    rows = items.select(F.col(key).alias("owner"), F.explode(values).alias("value")).select("owner", F.trim("value").alias("value")).where("owner IS NOT NULL AND value <> ''").distinct()
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.min("owner").alias("first_owner")).where(F.col("owners") >= least)


def memberships(items: DataFrame, key: str, values: str) -> DataFrame:
    """(owner, value, owners): who shares each value; values of a single owner are left out."""
    rows = items.select(F.col(key).alias("owner"), F.explode(values).alias("value")).select("owner", F.trim("value").alias("value")).where("owner IS NOT NULL AND value <> ''").distinct()
    return rows.join(owners(items, key, values).select("value", "owners"), "value").select("owner", "value", "owners")
