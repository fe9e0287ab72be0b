"""Sharding by rendezvous hashing: every shard draws a weighted score per record key, the highest score wins.

Native: DataFrame functions only. Moving from n to n + 1 shards moves a record only into the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalpact.llm.text import table

#: Ranges of hashed keys that are numbered side by side within a shard.
RANGES = 256
#: Numbers made at once when copies of one row are spread out again.
CHUNK = 100_000


def _unit(*parts: Column) -> Column:
    """A hashed number strictly between 0 and 1 with 52 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (from 0) that wins ``key``.

    A shard's score is ``-weight / ln(u)`` with a hashed ``u`` of the key and the shard number, so it
    wins a share of the keys in proportion to its weight. Equal scores go to the larger number. A null
    key counts as the text ``null``; weights must be positive.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("one positive weight per shard is needed")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct((F.lit(-float(w)) / F.ln(_unit(text, F.lit(str(i))))).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_max(F.array(*scores))["shard"]


def assign_shards(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", added: float = 1.0,
) -> DataFrame:
    """Put every row into a shard and number the rows of each shard from 0 without gaps.

    Returns the key, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``law`` (``key``),
    ``shard``, ``slot`` and ``grown_shard`` (the shard once one more of weight ``added`` exists).
    Other columns of the input are ignored. A null text has size 1 and the checksum of no bytes; rows
    with equal keys share a shard; repeated rows are numbered one by one; an empty table gives no rows.

    Equal rows are counted before the shuffle, so a hot key costs one row per task. Numbering sorts
    within (shard, range of hashed keys); the offsets of the ranges are shards x RANGES sums.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    grown = [*weights, added]
    rows = docs.select(
        F.col(key), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
    )
    counted = (
        rows.groupBy(key, "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "*", rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), grown).alias("grown_shard"),
            F.floor(_unit(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))
                    * F.lit(RANGES)).cast("int").alias("bucket"),
        )
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    offsets = sums.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = (
        Window.partitionBy("shard", "bucket").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        counted.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(F.broadcast(offsets), ["shard", "bucket"])  # shards x RANGES rows at most
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
        .withColumn("copy", F.explode(F.sequence("chunk", F.least(F.col("chunk") + CHUNK, F.col("n")) - 1)))
    )
    return placed.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("before") + F.col("copy")).alias("slot"), "grown_shard",
    )


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal weight, by doc_id."""
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * 8)


def _unit_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def _shard_sql(n: int) -> str:
    scores = ", ".join(f"{{s: -1.0 / ln({_unit_sql(f"d || ':{i}'")}), i: {i}}}" for i in range(n))
    return f"list_max([{scores}]).i"


_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC_TABLE = "list_transform(range(256), lambda x: x::BIGINT)"
for _ in range(8):
    _CRC_TABLE = f"list_transform({_CRC_TABLE}, lambda x: {_CRC_STEP.format('x')})"

OP9_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
base AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS d, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         hex(encode(coalesce(text, ''))) AS h
  FROM documents
), summed AS (
  SELECT doc_id, d, size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS BIGINT)]))) AS text_crc32
  FROM base, crc
), placed AS (
  SELECT *, {_shard_sql(8)} AS shard, {_shard_sql(9)} AS grown_shard,
         floor({_unit_sql("d || ':' || text_crc32")} * {RANGES}) AS bucket
  FROM summed
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""
