"""Versioned tables: every write is a new folder, and one small pointer says which is current.

Readers never see half a write: the data are complete before the pointer moves,
and the pointer moves by one rename. Several tables can move together. Old
versions stay until they are pruned. All files live in the folder that is
passed, which on a cluster is a shared one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def _put(spark: SparkSession, path: str, content: str) -> None:
    jvm = spark._jvm
    fs, p = _fs(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(content.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(new, p, options)


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """Writes new versions of the tables and makes them current together.

    If a write fails, the pointer has not moved and all tables are as before.
    """
    current = (_read(spark, f"{folder}/CURRENT") or {}).get("tables", {})
    for name, df in tables.items():
        version = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{folder}/{version}")
        current = current | {name: version}
    _put(spark, f"{folder}/CURRENT", json.dumps({"schema_version": SCHEMA_VERSION, "tables": current}))
    return current


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The current version of a table; a name never written, or a pointer of another schema version, is an error."""
    pointer = _read(spark, f"{folder}/CURRENT")
    if not pointer or name not in pointer["tables"]:
        raise KeyError(name)
    if pointer["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {pointer['schema_version']}")
    return spark.read.parquet(f"{folder}/{pointer['tables'][name]}")
