"""Session helpers: settings for tests and where lineage may be cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and benches. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one ``spark.checkpoint.dir`` names, or the context's checkpoint folder.

    Where none is set, a temporary folder serves on a single machine; a cluster
    has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="docloom-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder all executors share."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer splits than the cluster has cores.

    Splits follow from bytes (``spark.sql.files.maxPartitionBytes``), so only
    tables of less than a split per core are shuffled, however few or large
    their files are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if 0 < df.rdd.getNumPartitions() < cores else df
