"""References to records that do not exist (at the time of the reference).

Every table is turned into signed change deltas. An existence interval of a
record is ``+1`` at its start and ``-1`` at its end; a reference is ``+1``
reference. Both are summed per (key, time bucket) before anything is joined.
A running sum of the existence deltas over the buckets of a key is the
existence count a bucket starts with. A bucket with positive references is an
orphan bucket if the count is zero, safe if it is positive and untouched inside
the bucket, and decided by the deltas inside the bucket otherwise.

Only the sums travel per key, so a key that holds a third of all references is
many small bucket rows, not one large group. The references themselves meet
only the undecided and orphan buckets, in an equi-join on (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFERENCE_COLUMNS = ("ref_table", "record_id", "ref_field", "ref_id", "ref_at")

#: White space that makes an id blank, Unicode-wide.
BLANK = r"(?U)^\s*$"


def not_blank(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(BLANK)


def candidate_references(candidates: DataFrame) -> DataFrame:
    """Both section references of every related-section candidate."""
    return candidates.select(
        F.lit("related_section_candidates").alias("ref_table"),
        F.col("candidate_id").cast("string").alias("record_id"),
        F.col("generated_at").alias("ref_at"),
        F.explode(
            F.array(
                F.struct(F.lit("source_section_id").alias("f"), F.col("source_section_id").alias("v")),
                F.struct(F.lit("target_section_id").alias("f"), F.col("target_section_id").alias("v")),
            )
        ).alias("r"),
    ).select("ref_table", "record_id", F.col("r.f").alias("ref_field"), F.col("r.v").alias("ref_id"), "ref_at")


def conflict_references(items: DataFrame) -> DataFrame:
    """The section references of every conflict review item, from all its fields."""

    def tagged(field: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(field).alias("f"), v.alias("v")))

    return items.select(
        F.lit("conflict_review_items").alias("ref_table"),
        F.col("conflict_id").alias("record_id"),
        F.col("created_at").alias("ref_at"),
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit("left_section_id").alias("f"), F.col("section_pair.left_section_id").alias("v")),
                    F.struct(F.lit("right_section_id").alias("f"), F.col("section_pair.right_section_id").alias("v")),
                ),
                tagged("source_refs", F.col("source_refs.source_section_id")),
                tagged("related_sections", F.col("related_sections")),
            )
        ).alias("r"),
    ).select("ref_table", "record_id", F.col("r.f").alias("ref_field"), F.col("r.v").alias("ref_id"), "ref_at")


def _bucket(us: Column, seconds: int) -> Column:
    return F.floor(us / F.lit(seconds * 1_000_000)).cast("long")


def existence_deltas(records: DataFrame, key: str, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """(ref_id, dated, bucket, at, delta): signed existence changes of every key.

    ``dated`` rows follow the calendar. The others answer references without a
    time: one ``+1`` per row, before every bucket. An interval that ends no
    later than it starts never exists and gives no dated delta.
    """
    us = lambda c: F.unix_micros(F.col(c))
    lives = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    row = lambda ok, dated, at, d: F.when(ok, F.struct(F.lit(dated).alias("dated"), at.alias("at"), F.lit(d).cast("long").alias("delta")))
    return (
        records.where(F.col(key).isNotNull())
        .select(
            F.col(key).alias("ref_id"),
            F.explode(
                F.array_compact(
                    F.array(
                        row(lives, True, us(start), 1),
                        row(lives & F.col(end).isNotNull(), True, us(end), -1),
                        row(F.lit(True), False, F.lit(-1).cast("long"), 1),
                    )
                )
            ).alias("d"),
        )
        .select("ref_id", "d.*")
        .withColumn("bucket", F.when(F.col("dated"), _bucket(F.col("at"), bucket_seconds)).otherwise(F.lit(-1).cast("long")))
        .groupBy("ref_id", "dated", "bucket", "at")
        .agg(F.sum("delta").alias("delta"))
        .where("delta <> 0")
    )


def orphan_references(
    references: DataFrame,
    records: DataFrame,
    key: str = "section_id",
    start: str = "ingested_at",
    end: str = "deleted_at",
    bucket_seconds: int = 3600,
    salts: int = 16,
) -> DataFrame:
    """References whose key did not exist when they were made.

    ``references`` has at least ``ref_table, record_id, ref_field, ref_id,
    ref_at``; other columns, whatever their names, are ignored. A key exists at
    ``t`` if one of its rows has ``start <= t`` and ``end`` null or later than
    ``t``. A reference with a null ``ref_at`` is an orphan if no row at all has
    its key. Null and blank keys are no references. Ids compare exactly.
    Repeated rows count once; empty tables give an empty report, or all
    references if only ``records`` is empty. Result: the five columns, distinct.

    References without a time cannot be spread over the calendar, so their
    buckets are ``salts`` hash groups of the record id.
    """
    refs = (
        references.select(*REFERENCE_COLUMNS)
        .where(not_blank(F.col("ref_id")))
        .withColumn("dated", F.col("ref_at").isNotNull())
        .withColumn("at", F.unix_micros("ref_at"))
        .withColumn("bucket", F.when(F.col("dated"), _bucket(F.col("at"), bucket_seconds)).otherwise(F.pmod(F.xxhash64("record_id"), F.lit(salts))))
    )
    deltas = existence_deltas(records, key, start, end, bucket_seconds)
    counts = (
        refs.select("ref_id", "dated", "bucket", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("delta"), F.lit(None).cast("struct<at:bigint,delta:bigint>").alias("step"))
        .unionByName(deltas.select("ref_id", "dated", "bucket", F.lit(0).cast("long").alias("refs"), "delta", F.struct("at", "delta").alias("step")))
        .groupBy("ref_id", "dated", "bucket")
        .agg(F.sum("refs").alias("refs"), F.sum("delta").alias("delta"), F.collect_list("step").alias("steps"))
    )
    before = Window.partitionBy("ref_id", "dated").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    doubtful = (
        counts.withColumn("carry", F.coalesce(F.sum("delta").over(before), F.lit(0)))
        .where((F.col("refs") > 0) & ((F.col("carry") == 0) | (F.size("steps") > 0)))
        .select("ref_id", "dated", "bucket", "carry", "steps")
    )
    alive = F.col("carry") + F.aggregate(
        F.filter("steps", lambda s: s["at"] <= F.col("at")), F.lit(0).cast("long"), lambda total, s: total + s["delta"]
    )
    return refs.join(doubtful, ["ref_id", "dated", "bucket"]).where(alive == 0).select(*REFERENCE_COLUMNS).distinct()


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphan references counted per table, field and period of the reference (null: undated)."""
    return orphans.groupBy("ref_table", "ref_field", F.date_trunc(period, "ref_at").alias("period")).agg(
        F.count(F.lit(1)).alias("orphans"), F.countDistinct("record_id").alias("records"), F.countDistinct("ref_id").alias("ids")
    )


def reference_state(references: DataFrame, records: DataFrame, key: str = "section_id", start: str = "ingested_at", end: str = "deleted_at") -> DataFrame:
    """(ref_id, refs, existing): the counts per key as of now, from whole tables."""
    refs = references.select(*REFERENCE_COLUMNS).where(not_blank(F.col("ref_id"))).distinct()
    lives = records.where(F.col(start).isNotNull()).select(key, start, end).distinct()
    return apply_deltas(
        refs.select("ref_id", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("existing")),
        lives.where(F.col(key).isNotNull()).select(F.col(key).alias("ref_id"), F.lit(0).cast("long").alias("refs"), F.col(end).isNull().cast("long").alias("existing")),
    )


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """Merge signed (ref_id, refs, existing) deltas into a state of the same columns.

    Keys whose two counts fall to zero leave the state.
    """
    return summed(state, deltas).where("refs <> 0 OR existing <> 0")


def summed(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The counts of a state with those of deltas, zeros kept."""
    columns = ("ref_id", "refs", "existing")
    return state.select(*columns).unionByName(deltas.select(*columns)).groupBy("ref_id").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence."""
    return state.where("refs > 0 AND existing = 0").select("ref_id", "refs")
