"""Keyed tables over time: diffs, upserts, patches, verification and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, first_column): added, removed and changed keys, and the first column in order that differs.

    Both tables have one row per key. Nulls are values: null against a value is
    a difference, null against null is none.
    """
    a = before.select(F.col(key), F.struct(*columns).alias("a"))
    b = after.select(F.col(key), F.struct(*columns).alias("b"))
    differs = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.coalesce(*differs).isNotNull(), "changed")
    rows = a.join(b, key, "full").select(key, change.alias("change"), F.when(change == "changed", F.coalesce(*differs)).alias("first_column"))
    return rows.where("change IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of theirs and without ``deleted`` keys; a key in both is kept as new."""
    touched = new.select(key).unionByName(deleted.select(key)).distinct()
    return old.join(touched, key, "left_anti").unionByName(new, allowMissingColumns=True)


def patch_column(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Replaces one column where ``values`` has a non-null one for the key."""
    new = values.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def verify(manifest: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, issue, fields): missing and stale keys, and the columns in which the two differ."""
    a = manifest.select(F.col(key), F.struct(*columns).alias("a"))
    b = stored.select(F.col(key), F.struct(*columns).alias("b"))
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    issue = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "stale").when(F.size(fields) > 0, "mismatch")
    none = F.array().cast("array<string>")
    return a.join(b, key, "full").select(key, issue.alias("issue"), F.when(issue == "mismatch", fields).otherwise(none).alias("fields")).where("issue IS NOT NULL")


def fingerprint(rows: DataFrame, group: str, parts: list[str]) -> DataFrame:
    """(group, rows, fingerprint): equal for equal bags of rows, whatever their order.

    A row's line is its parts, joined by '|' (null as empty). The SHA-256 of the
    line is cut into four numbers of 48 bits whose exact sums, with the number
    of rows, are hashed again. Sums combine before the shuffle, so a group of
    any size is four numbers per map task, never a sorted list of its rows.
    """
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    number = lambda i: F.sum(F.conv(F.substring(line, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)"))
    total = F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[number(i).cast("string") for i in range(4)])
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.sha2(total, 256).alias("fingerprint"))


def drifted(current: Column, stored: Column) -> Column:
    """Whether two hashes differ; a missing one says nothing. Case does not count."""
    return F.coalesce(F.lower(current) != F.lower(stored), F.lit(False))


def base_changed(base: Column, current: Column) -> Column:
    """Whether a recorded base hash no longer holds; a missing one counts as changed."""
    return ~F.coalesce(F.lower(base) == F.lower(current), F.lit(False))


def renames(before: DataFrame, after: DataFrame, uid: str, key: str, body: str) -> DataFrame:
    """(uid, old_key, new_key, kind) of rows with one identity whose key or body changed.

    kind: 'renamed', 'edited' or 'renamed_and_edited'. Identities that several
    rows of one side share decide nothing and are left out.
    """

    def unique(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(uid).isNotNull()).groupBy(uid).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, body)).alias(name)).where("n = 1").drop("n")

    both = unique(before, "x").join(unique(after, "y"), uid)
    moved, edited = F.col(f"x.{key}") != F.col(f"y.{key}"), drifted(F.col(f"y.{body}"), F.col(f"x.{body}"))
    kind = F.when(moved & edited, "renamed_and_edited").when(moved, "renamed").when(edited, "edited")
    return both.select(F.col(uid), F.col(f"x.{key}").alias("old_key"), F.col(f"y.{key}").alias("new_key"), kind.alias("kind")).where("kind IS NOT NULL")
