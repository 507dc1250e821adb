"""The change operators on Structured Streaming.

State and output live under the folder all executors share (``session.shared_folder``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import session
from docloom.operators import references as R
from docloom.session import cut_lineage
from docloom.streaming.state import BucketedState


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run."""
    return f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, data_dir: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """The parquet table ``name`` as a stream of its files."""
    schema = spark.read.parquet(f"{data_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{data_dir}/{name}.parquet*")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream over everything that is there and reads back what it wrote."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed_changes(events: DataFrame, at: str, kind: str, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(start, kind, n, total) per window the watermark has closed, for streams without end.

    Open windows are not out yet, and events more than ``lateness`` behind an
    earlier micro-batch are dropped. ``whole_windows`` has neither cut.
    """
    return events.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def whole_windows(stream: DataFrame, at: str, kind: str, name: str, width: str = "1 day") -> DataFrame:
    """(start, kind, n, total, last) per window of everything that is there, ``last`` being its latest event.

    Sums per window are merged by batch number as in ``latest_by_key``, so late
    rows join their window and counts do not depend on files or their order.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    done: dict[str, int] = {}

    def sums(batch: DataFrame) -> DataFrame:
        keyed = batch.where(F.col(at).isNotNull()).groupBy(F.window(at, width).alias("w"), kind)
        return keyed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max(at).alias("last")).select(F.col("w.start").alias("start"), kind, "n", "total", "last")

    def merge(batch: DataFrame, number: int) -> None:
        parts = sums(batch)
        if number:
            parts = parts.unionByName(spark.read.parquet(f"{folder}/v{number - 1}"))
        merged = parts.groupBy("start", kind).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))
        merged.write.mode("overwrite").parquet(f"{folder}/v{number}")
        done["version"] = number

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(f"{folder}/v{done['version']}") if done else spark.createDataFrame([], sums(stream).schema)
    return found.withColumn("total", F.round("total", 4))


def drain_batches(stream: DataFrame, folder: str, name: str, merge: Callable[[DataFrame, int], None], first: int = 0) -> int:
    """Hands everything that is there to ``merge`` in micro-batches numbered from ``first`` on; the number of the last one."""
    done = {"last": first - 1}

    def run(batch: DataFrame, number: int) -> None:
        merge(batch, first + number)
        done["last"] = first + number

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return done["last"]


def latest_by_key(stream: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """The last row per key of a stream; every micro-batch rewrites the state's buckets it touches. Rows without a key are left out."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    columns = [c for c in stream.columns if c != key]
    state = BucketedState(spark, f"{folder}/latest", key, ", ".join(f"`{n}` {t}" for n, t in stream.dtypes))

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new)
        return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*").select(*stream.columns)

    last = drain_batches(stream, folder, "stream", lambda batch, number: state.merge(batch.where(F.col(key).isNotNull()), number, newest))
    return state.rows(last)


def maintained_orphans(spark: SparkSession, data_dir: str, files_per_batch: int = 8) -> DataFrame:
    """(ref_id, refs): keys with references and no existing record, from counts that change deltas maintain.

    References and records arrive as streams, in any order and with repeated
    rows. Facts that are new (told by 128 bits of hash within their key's
    bucket) become signed deltas of the two counts of their key, and the deltas
    are merged into the stored counts. Equal to ``references.reference_state``
    over the whole tables.
    """
    folder = shared_folder(spark, "orphans")
    facts = BucketedState(spark, f"{folder}/facts", "ref_id", "ref_id string, h1 bigint, h2 bigint")
    counts = BucketedState(spark, f"{folder}/counts", "ref_id", "ref_id string, refs bigint, existing bigint")

    def apply(deltas: DataFrame, number: int) -> None:
        new = deltas.dropDuplicates(["ref_id", "h1", "h2"]).join(facts.touched(deltas, number), ["ref_id", "h1", "h2"], "left_anti")
        new = cut_lineage(new)
        counts.merge(new, number, lambda old, more: R.summed(old, more))
        facts.merge(new.select("ref_id", "h1", "h2"), number, lambda old, more: old.unionByName(more))

    hashed = lambda df, *parts: df.withColumn("h1", F.xxhash64(*parts)).withColumn("h2", F.xxhash64(F.lit(1), *parts))

    def references(rows: DataFrame) -> DataFrame:
        refs = rows.where(R.not_blank(F.col("ref_id")))
        return hashed(refs, *R.REFERENCE_COLUMNS).select("ref_id", "h1", "h2", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("existing"))

    def records(rows: DataFrame) -> DataFrame:
        lives = rows.where("section_id IS NOT NULL AND ingested_at IS NOT NULL").withColumnRenamed("section_id", "ref_id")
        return hashed(lives, "ref_id", "ingested_at", "deleted_at").select("ref_id", "h1", "h2", F.lit(0).cast("long").alias("refs"), F.col("deleted_at").isNull().cast("long").alias("existing"))

    number = 0
    for name, deltas in (("related_section_candidates", lambda b: references(R.candidate_references(b))), ("sections", records), ("conflict_review_items", lambda b: references(R.conflict_references(b)))):
        number = 1 + drain_batches(stream_table(spark, data_dir, name, files_per_batch), folder, name, lambda batch, n, deltas=deltas: apply(deltas(batch), n), number)
    return R.current_orphans(counts.rows(number - 1))
