"""Sparse and dense vectors as columns and long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_id(token: Column) -> Column:
    """The first four bytes of the token's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long")


def hashed_sparse(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, token_id, weight): the counts of the hashed tokens of each row."""
    exploded = rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    return exploded.groupBy(key, token_id(F.col("token")).alias("token_id")).agg(F.sum("n").cast("double").alias("weight"))


def hashed_dense(rows: DataFrame, key: str, tokens: str, dim: int) -> DataFrame:
    """(key, slot, value): signed counts of tokens hashed into ``dim`` slots, to length 1; the sign is the parity of the fifth byte.

    A row whose counts cancel out, or without tokens, has no slots.
    """
    digest = F.sha2("token", 256)
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    counted = rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    slots = counted.select(key, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim).cast("int").alias("slot"), (sign * F.col("n")).alias("v"))
    summed = slots.groupBy(key, "slot").agg(F.sum("v").cast("double").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return summed.select(key, "slot", F.round(F.col("v") / norm, 6).alias("value"))


def normal_sparse(indices: Column, values: Column) -> Column:
    """(index, value) pairs by index: repeated indices summed, zeros and non-finite values dropped; null parts give none."""
    pairs = F.filter(F.arrays_zip(indices.alias("i"), values.alias("v")), lambda p: p["i"].isNotNull() & p["v"].isNotNull() & ~F.isnan(p["v"]) & (F.abs(p["v"]) != float("inf")))
    ids = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["i"])))
    total = lambda i: F.aggregate(F.filter(pairs, lambda p: p["i"] == i), F.lit(0.0), lambda a, p: a + p["v"].cast("double"))
    summed = F.filter(F.transform(ids, lambda i: F.struct(i.alias("index"), total(i).alias("value"))), lambda s: s["value"] != 0)
    return F.coalesce(summed, F.array().cast("array<struct<index:int,value:double>>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when a norm is 0, null when sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))
