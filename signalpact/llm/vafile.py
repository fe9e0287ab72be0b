"""Exact top-k inner-product search with vector-approximation files.

Components become integers and are quantised into cells. A first scan reads only the cells: they bound a
query's score with every vector from below and above, and vectors whose upper bound misses the k-th best
lower bound are out. Exact vectors are then read in the order of their bounds, in two waves: the most
promising ones fix a k-th exact score, and only vectors that may still beat it are read after them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalpact.llm.text import table
from signalpact.session import cut_lineage

#: Integer steps per unit of a component.
SCALE = 1024
#: Cells of the quantiser, at most 256.
CELLS = 64
#: Vectors whose components place the cell borders, at most (least hash first).
SAMPLE = 4096
#: Cells of vectors in a data block and vectors in a query block, on average.
DATA_BLOCK, QUERY_BLOCK = 8192, 256
K = 10


def to_integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as bigint; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def borders(vectors: DataFrame, cells: int, sample: int) -> np.ndarray:
    """Lower borders of the cells: quantiles of a bounded sample, the outer ones at the true extremes."""
    some = vectors.orderBy(F.xxhash64("v")).limit(sample).select("v").toPandas()["v"]
    low, high = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    values = np.concatenate([np.asarray(v, np.int64) for v in some]) if len(some) else np.zeros(0, np.int64)
    if not len(values):
        return np.array([0, 1], np.int64)
    inner = np.unique(np.quantile(values, np.linspace(0, 1, cells + 1)[1:-1]).astype(np.int64))
    inner = inner[(inner > low) & (inner <= high)]
    return np.concatenate([[low], inner, [high + 1]]).astype(np.int64)


def quantise(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return (np.searchsorted(edges, values, side="right") - 1).astype(np.uint8)


def bounds(query: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of each query with each vector of the given cells."""
    low, high = edges[:-1][codes].astype(np.float64), (edges[1:] - 1)[codes].astype(np.float64)
    plus, minus = np.maximum(query, 0).astype(np.float64), np.minimum(query, 0).astype(np.float64)
    # Sums of products of integers are exact in doubles below 2**53; beyond, a margin keeps the bounds safe.
    lower, upper = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
    slack = np.maximum(np.abs(lower), np.abs(upper)).max(initial=0) * 1e-12
    slack = slack if slack > 1 else 0.0
    return lower - slack, upper + slack


def _scan(edges: np.ndarray, k: int):
    """Candidates of one (query block, data block): everything its own k-th lower bound leaves open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, queries = np.asarray(row.ids), np.asarray(row.query_ids)
                codes = np.frombuffer(b"".join(row.codes), np.uint8).reshape(len(ids), -1)
                vectors = np.array([np.asarray(v, np.int64) for v in row.queries])
                for i in range(0, len(queries), 64):
                    lower, upper = bounds(vectors[i:i + 64], codes, edges)
                    if len(ids) > k:
                        floor = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
                    else:
                        floor = np.full(len(lower), -np.inf)
                    at, found = np.nonzero(upper >= floor[:, None])
                    yield pd.DataFrame({"query": queries[i + at], "cls": ids[found],
                                        "lower": lower[at, found], "upper": upper[at, found]})
    return run


def top_k(
    vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = SCALE, cells: int = CELLS, sample: int = SAMPLE,
) -> DataFrame:
    """The ``k`` vectors of highest integer inner product for every row that ``queries`` selects.

    Returns query_id, rank (from 1), vec_id and score; a query meets every row but its own, equal scores
    go to the smaller id. Vectors that are null or hold null, NaN or infinite components take no part, nor
    do rows without an id; a query meets only vectors of its own length. A repeated id counts once per
    distinct vector, as candidate and as query. Fewer than ``k`` candidates give fewer rows.

    Equal vectors are searched once: a class keeps its k + 1 smallest ids, cut before the shuffle. Blocks
    of about QUERY_BLOCK x DATA_BLOCK distinct vectors meet; nothing is collected but the sample.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), to_integers(F.col(vector_col), scale).alias("v"),
                           queries.alias("asked")).where("id IS NOT NULL AND v IS NOT NULL").distinct()
    first = Window.partitionBy("v").orderBy("id")
    members = (
        clean.select("id", "v").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    classes = cut_lineage(members.select(F.monotonically_increasing_id().alias("cls"), "v", "ids"), "classes")
    asked = clean.where("asked").select("id", "v").distinct().join(classes.select("cls", "v"), "v")
    asked = cut_lineage(asked.select("id", "cls", "v"), "asked")
    edges = borders(classes, cells, sample)

    @F.pandas_udf("binary")
    def coded(v: pd.Series) -> pd.Series:
        return v.map(lambda x: quantise(np.asarray(x, np.int64), edges).tobytes())

    distinct = asked.groupBy("cls").agg(F.first("v").alias("v"))
    data_blocks = -(-classes.count() // DATA_BLOCK) or 1
    query_blocks = -(-distinct.count() // QUERY_BLOCK) or 1
    data = (
        classes.select(F.size("v").alias("width"), F.pmod(F.xxhash64("cls"), F.lit(data_blocks)).alias("block"), "cls", coded("v").alias("code"))
        .groupBy("width", "block").agg(F.collect_list("cls").alias("ids"), F.collect_list("code").alias("codes"))
    )
    wanted = (
        distinct.select(F.size("v").alias("width"), F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(query_blocks)).alias("query_block"), "cls", "v")
        .groupBy("width", "query_block").agg(F.collect_list("cls").alias("query_ids"), F.collect_list("v").alias("queries"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(data_blocks - 1).cast("long"))))
    )
    grid = wanted.join(data, ["width", "block"]).repartition(F.col("width"), F.col("block"), F.col("query_block"))
    scanned = cut_lineage(
        grid.select("ids", "codes", "query_ids", "queries")
        .mapInPandas(_scan(edges, k + 1), "query long, cls long, lower double, upper double"), "scanned")

    # The k-th lower bound over all blocks leaves the candidates; they are numbered in the order of their bounds.
    by_lower = Window.partitionBy("query").orderBy(F.col("lower").desc(), "cls")
    floor = (
        scanned.withColumn("place", F.row_number().over(by_lower)).where(F.col("place") <= k + 1)
        .groupBy("query").agg(F.min("lower").alias("floor"), F.count(F.lit(1)).alias("n"))
    )
    open_ = scanned.join(floor, "query").where((F.col("n") < k + 1) | (F.col("upper") >= F.col("floor")))
    by_upper = Window.partitionBy("query").orderBy(F.col("upper").desc(), "cls")
    candidates = cut_lineage(open_.select("query", "cls", "upper", F.row_number().over(by_upper).alias("place")), "candidates")

    right = classes.select("cls", F.col("v").alias("w"))
    left = distinct.select(F.col("cls").alias("query"), "v")
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)

    def read(rows: DataFrame) -> DataFrame:
        return rows.select("query", "cls").join(right, "cls").join(left, "query").select("query", "cls", product.alias("score"))

    wave = 2 * (k + 1)
    sure = cut_lineage(read(candidates.where(F.col("place") <= wave)), "read")
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "cls")
    kth = (
        sure.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
        .groupBy("query").agg(F.min("score").alias("kth"))
    )
    rest = candidates.where(F.col("place") > wave).join(kth, "query").where(F.col("upper") >= F.col("kth"))
    found = sure.unionByName(read(rest))

    # A class beyond rank k + 1 can't hold a result: each better one holds an id at least, one of them the query's own.
    rank = Window.partitionBy("query").orderBy(F.col("score").desc())
    best = found.withColumn("place", F.rank().over(rank)).where(F.col("place") <= k + 1).join(classes.select("cls", "ids"), "cls")
    listed = best.select("query", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")))
    top = listed.where(F.col("place") <= 2 * k + 2)
    final = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return (
        asked.select(F.col("id").alias("query_id"), F.col("cls").alias("query")).join(top, "query")
        .where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op3_vector_approximation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of all embeddings for every vec_id divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
