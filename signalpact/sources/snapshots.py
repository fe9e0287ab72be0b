"""Stored sample payloads, partitioned by the plan revision they were taken under."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalpact.model import local_table
from signalpact.session import cut_lineage

SNAPSHOTS_DDL = "id bigint, event_name string, payload string, created_at timestamp, sha string"
CHUNK_ROWS = 10_000
CHUNK_BYTES = 16 << 20
BROADCAST_EVENTS = 100_000


def save_snapshots(df: DataFrame, path: str, sha: str | None = None, save_id: str | None = None) -> None:
    """Add samples (id, event_name, payload[, created_at]) under their sha, all or nothing.

    A save is a folder of its own, and counts once its line stands in the manifest, which is written
    last: half a save is never read. A save that is repeated under the same ``save_id`` (after a failure, or
    by mistake) takes the place of the first.
    """
    save_id = save_id or uuid.uuid4().hex
    if not re.fullmatch(r"[\w.-]+", save_id):
        raise ValueError(f"save id {save_id!r}: letters, digits, _, . and - only")
    out = df if sha is None else df.withColumn("sha", F.lit(sha))
    if "created_at" not in out.columns:
        out = out.withColumn("created_at", F.current_timestamp())
    out.select("id", "event_name", "payload", "created_at", "sha").write.mode("overwrite").partitionBy(
        "sha").parquet(f"{path}/saves/save_id={save_id}")
    local_table(df.sparkSession, [(save_id,)], "saved string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/save={save_id}")


def load_snapshots(spark: SparkSession, path: str, sha: str | None = None) -> DataFrame:
    """Samples of all finished saves as rows; with ``sha`` only that partition is read."""
    saved = spark.read.schema("saved string").parquet(f"{path}/manifest").select("saved")
    df = spark.read.schema(f"{SNAPSHOTS_DDL}, save_id string").parquet(f"{path}/saves")
    df = df if sha is None else df.filter(F.col("sha") == sha)
    return df.join(saved, F.col("save_id") == F.col("saved"), "left_semi").select("id", "event_name", "payload", "created_at", "sha")


def snapshots_by_event(
    snapshots: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Samples grouped by event: (event_name, chunk, payloads).

    A frequent event is spread over as many chunks as its rows and its bytes ask for (about
    ``chunk_rows`` and ``chunk_bytes`` each), so no task ever holds a whole event; all chunks of an
    event together are its samples.
    """
    counted = snapshots.groupBy("event_name").agg(
        F.greatest(F.count(F.lit(1)) / F.lit(chunk_rows), F.sum(F.octet_length("payload")) / F.lit(chunk_bytes)).alias("__n"))
    sizes = cut_lineage(counted, "sizes")
    # Joining by event would bring a frequent one together after all; so broadcast where it fits.
    few = sizes.limit(BROADCAST_EVENTS + 1).count() <= BROADCAST_EVENTS
    sizes = F.broadcast(sizes) if few else sizes
    chunks = F.greatest(F.ceil("__n"), F.lit(1)).cast("int")
    placed = snapshots.join(sizes, "event_name").withColumn(
        "chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")
    )
    return placed.groupBy("event_name", "chunk").agg(F.collect_list("payload").alias("payloads"))
