"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parts per core of an input that is spread.
PARTS_PER_CORE = 4
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session options the operators need (all are runtime options)."""
    # A repeated JSON key keeps its last value instead of making the document unreadable.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A fused stage whose method is beyond what the JIT compiles runs interpreted; above this size
    # Spark generates the projection in small methods instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def accept_repeated_keys(spark: SparkSession) -> None:
    """Let the JSON reader take documents that repeat a key (the last value stays).

    Called wherever documents are parsed, so that the same document gives the same result in a
    session nobody configured.
    """
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    A machine-local folder is made up only when the setting is absent and the master is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = os.path.join(tempfile.gettempdir(), f"signalpact-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten there."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer partitions than cores (one small file, one row group).

    Small files can hold many rows, so a core gets several parts: the longest task is a fraction of its work.
    Inputs of any size worth distributing have more partitions than that and stay unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(PARTS_PER_CORE * cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lost executors cannot undo it.

    The shuffle files of this one write go when it is done: nothing reads them any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`cut_lineage` wrote, once all that read it has been written itself."""
    spark, path = table.sparkSession, table._scratch
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
