"""Text files as documents, and JSON records read with tolerance."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def scan_texts(spark: SparkSession, root: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """(path, text) of the files below ``root`` that match an include and no exclude pattern.

    Patterns are globs on the path relative to ``root``; ``*`` crosses folders.
    Paths with ``..`` are refused. Files are listed and read by Spark, whole, as
    UTF-8; empty files are no documents; no match at all is an error.
    """
    if any(".." in p.split("/") for p in (*include, *exclude)):
        raise ValueError("patterns must stay below the root")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.concat(F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/"), F.lit("/"))
    path = F.expr("regexp_replace(path, '^[a-z0-9]+:/*', '/')")
    relative = F.when(path.startswith(at), F.substring(path, F.length(at) + 1, F.length(path)))
    pattern = lambda globs: "|".join(translate(g).replace(r"\z", r"\Z") for g in globs)
    rows = files.select(relative.alias("path"), F.col("content")).where(F.col("path").rlike(pattern(include)))
    if exclude:
        rows = rows.where(~F.col("path").rlike(pattern(exclude)))
    rows = rows.select("path", F.decode("content", "UTF-8").alias("text"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no file below {root} matches {include}")
    return rows


def read_records(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable): JSON lines of a schema, and the lines that are none of it."""
    full = StructType([*schema.fields, StructField("_unreadable", StringType())])
    lines = spark.read.text(path).select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unreadable"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._unreadable").isNotNull()
    return lines.where(~bad).select("r.*").drop("_unreadable"), lines.where(bad).select(F.col("value").alias("line"))


def json_in_text(text, schema: str):
    """A JSON object inside other text, as a struct: fenced, or from the first to the last brace; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(bare), schema)
