"""Keyed state of a stream in a shared folder: hash buckets, of which a micro-batch rewrites the touched ones only.

Every bucket has two slots. A batch reads a bucket's current slot and writes the
merged rows into the other, then writes the list of current slots under its own
number. A batch that is repeated after a failure finds the list of the batch
before it and the slots that list names untouched, so it does the same again.
There is no more on disk than two copies of the state and one short list a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


class BucketedState:
    """Rows of ``schema`` that belong to keys; a bucket's merged rows must not be empty."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder, key, schema, buckets

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _slots(self, number: int) -> dict[int, int]:
        """The current slot of every bucket after batch ``number``; at most one row per bucket."""
        if number < 0:
            return {}
        return {r.bucket: r.slot for r in self.spark.read.schema("bucket int, slot int").parquet(f"{self.folder}/slots/{number}").collect()}

    def _read(self, slots: dict[int, int]) -> DataFrame:
        if not slots:
            return self.spark.createDataFrame([], self.schema)
        wanted = F.lit(False)
        for slot in (0, 1):
            wanted = wanted | ((F.col("slot") == slot) & F.col("bucket").isin(*[b for b, s in slots.items() if s == slot]))
        rows = self.spark.read.schema(f"{self.schema}, bucket int, slot int").parquet(f"{self.folder}/rows").where(wanted)
        return rows.drop("bucket", "slot")

    def rows(self, number: int) -> DataFrame:
        """The whole state after batch ``number``."""
        return self._read(self._slots(number))

    def touched(self, batch: DataFrame, number: int) -> DataFrame:
        """The state's rows in the buckets of the keys of ``batch``, as they were before batch ``number``."""
        mine = {r.bucket for r in batch.select(self.bucket().alias("bucket")).distinct().collect()}
        return self._read({b: s for b, s in self._slots(number - 1).items() if b in mine})

    def merge(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the touched buckets by ``merge(their rows, batch)``."""
        slots = self._slots(number - 1)
        mine = {r.bucket for r in batch.select(self.bucket().alias("bucket")).distinct().collect()}
        after = {**slots, **{b: 1 - slots.get(b, 1) for b in mine}}
        if mine:
            merged = merge(self._read({b: s for b, s in slots.items() if b in mine}), batch)
            slot = F.create_map(*[F.lit(x) for b in sorted(mine) for x in (b, after[b])])[F.col("bucket")]
            merged.withColumn("bucket", self.bucket()).withColumn("slot", slot).repartition("bucket").write.partitionBy("bucket", "slot").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/rows")
        self.spark.createDataFrame(sorted(after.items()), "bucket int, slot int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/slots/{number}")
