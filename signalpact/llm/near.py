"""Near-duplicate documents by HyperMinHash.

A document's shingles are hashed once. The hash picks a bucket; the bucket keeps its smallest remaining
hash as a leading-zero count and some mantissa bits. Empty buckets borrow by hashing until they meet a
filled one, so short documents are compared as well. Runs of registers are banded; documents that share a
band are candidates, weighed by the collision-corrected Jaccard estimate and confirmed on their full sets.

Connected components need no pair inside a component. So every document is first confirmed against the
two best of its band leaders. Pairs across components that share a band are left. There a document's rare
shingles count: a pair shares one of them, which the few documents that hold it tell, or none of them, which
bounds the pair's similarity and sets most pairs aside by their sizes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalpact.llm.text import (
    LOWER, free_names, gram_hashes, mix, numbered, per_text, quoted, signed, table, text_bytes, tidy, word_hashes,
)
from signalpact.session import cut_lineage, discard

#: Words of a shingle and the similarity of a link in per cent.
SHINGLE, PERCENT = 5, 75
#: Registers, mantissa bits and registers per band. A pair at the threshold misses all bands once in 200,000.
REGISTERS, MANTISSA, ROWS = 128, 10, 4
#: Pairs whose corrected estimate is this far below the threshold (six deviations at least) are not read.
SLACK = 0.3
#: Documents compared with one leader by one task.
STAR = 256
#: Leaders that a document is confirmed against at first.
LEADERS = 2
#: A shingle of this many documents at most is rare, where bands still mix components.
RARE = 24
#: Bytes of row numbers, labels or pairs that are sent to every task; beyond it they are joined by shuffles.
BROADCAST_BYTES = 16 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = word_hashes(text_bytes(text).translate(LOWER))
    if not len(words):
        return words
    if len(words) < k:
        return gram_hashes(words, len(words)) + np.uint64(len(words))
    return np.unique(gram_hashes(words, k))


def _borrowed(registers: int) -> np.ndarray:
    """Places that each empty bucket asks in turn: the same for every document."""
    at = np.arange(registers, dtype=np.uint64)[:, None] * np.uint64(4096) + np.arange(64, dtype=np.uint64)[None]
    return (mix(at * _STEP) % np.uint64(registers)).astype(np.int64)


_ASK: dict[int, np.ndarray] = {}


def sketch(shingles: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """Registers of a set: (leading zeros << mantissa) + the bits after the first one; 16 bits each.

    An empty set has registers of 0xFFFF. A smaller remaining hash has more leading zeros; among equal
    counts the smaller mantissa wins, as in a minimum.
    """
    if not len(shingles):
        return np.full(registers, 0xFFFF, np.uint16)
    mixed = mix(shingles * _STEP)
    bucket = (mixed % np.uint64(registers)).astype(np.int64)
    rest = mixed >> np.uint64(registers.bit_length() - 1)
    least = np.full(registers, _EMPTY)
    np.minimum.at(least, bucket, rest)
    filled = least != _EMPTY
    width = 64 - (registers.bit_length() - 1)
    value = np.zeros(registers, np.int64)
    have = least[filled]
    # frexp gives the bit length; the top 53 bits decide it exactly once the low ones are cleared.
    length = np.frexp((have & ~np.uint64(0xFFF)).astype(np.float64))[1].astype(np.int64)
    low = have < np.uint64(4096)
    length[low] = np.frexp(have[low].astype(np.float64))[1]
    zeros = np.minimum(width - length, 62)
    shift = np.maximum(length - 1 - mantissa, 0).astype(np.uint64)
    bits = (have >> shift).astype(np.int64) & ((1 << mantissa) - 1)
    value[filled] = (zeros << mantissa) + bits
    if not filled.all():
        ask = _ASK.setdefault(registers, _borrowed(registers))
        empty = np.flatnonzero(~filled)
        usable = filled[ask[empty]]
        first = usable.argmax(axis=1)
        source = ask[empty, first]
        none = ~usable[np.arange(len(empty)), first]  # 64 misses: walk on from the bucket
        for i in np.flatnonzero(none):
            at = empty[i]
            while not filled[at]:
                at = (at + 1) % registers
            source[i] = at
        value[empty] = value[source]
    return value.astype(np.uint16)


def bands(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per run of ``rows`` registers, with the number of the run in it."""
    r = registers.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(r), dtype=np.uint64) * _STEP + np.uint64(1)
    for j in range(rows):
        key = mix(key * _STEP + r[:, j])
    return signed(key)


def collision_rate(mantissa: int = MANTISSA) -> float:
    """Chance that two different minima share a register: equal leading zeros and mantissa bits.

    The published bound for disjoint sets of any size that fill their buckets (Yu and Weber, HyperMinHash).
    """
    return 0.1699 * 2.0 ** -mantissa


def estimate(a: np.ndarray, b: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Collision-corrected Jaccard estimate of registers in rows of ``a`` and ``b``."""
    same = (a == b).mean(axis=-1)
    c = collision_rate(mantissa)
    return np.clip((same - c) / (1 - c), 0, 1)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """percent * |a or b| <= 100 * |a and b| on sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) of the nodes in (a, b) edges: the smallest node that is reachable.

    Labels move along the edges and jump to the label of their label, so the rounds grow with the
    logarithm of the longest chain. Every round is written to the shared folder.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), purpose)
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), purpose)
    while True:
        near = both.join(_light(labels.select(F.col("node").alias("b"), "label"), 64), "b")
        moved = (
            near.select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("own"))
            .unionByName(labels.select("node", "label", F.col("label").alias("own")))
            .groupBy("node").agg(F.min("own").alias("label"), F.min("label").alias("next"))
        )
        jump = _light(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), 64)
        new = cut_lineage(moved.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")), purpose)
        if not new.where("next <> label").limit(1).count():
            return new.select("node", F.col("next").alias("component"))
        labels = new.select("node", F.col("next").alias("label"))


def _light(stored_rows: DataFrame, width: int) -> DataFrame:
    """A written table as a broadcast side while its rows times ``width`` bytes stay within the bound, else as it is."""
    return F.broadcast(stored_rows) if width * stored_rows.count() <= BROADCAST_BYTES else stored_rows


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rid, shingles binary) of the rows numbered in ``wanted``; the numbers are broadcast within their bound."""
    small = 8 * wanted.count() <= BROADCAST_BYTES
    texts = docs.select("rid", "text").join(F.broadcast(wanted) if small else wanted, "rid", "left_semi")

    def make():
        return lambda rows: {"shingles": [shingle_set(t, k).tobytes() for t in rows]}

    return per_text(texts, ["rid"], "text", make, "shingles binary")


def _mixed(keys: DataFrame, part: DataFrame) -> DataFrame:
    """(key, rid, part) of the bands that hold more than one component."""
    placed = keys.join(_light(part.withColumnRenamed("node", "rid"), 64), "rid", "left").select("key", "rid", "weight", F.coalesce("component", "rid").alias("part"))
    several = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    return cut_lineage(placed.join(several.select("key"), "key"), "mixed")


def _across(docs: DataFrame, mixed: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) across the components of ``mixed`` that share a band and may be similar.

    Let u of a document's n shingles be rare. A pair that shares a rare one is listed by that shingle, of
    which RARE documents at most exist. Any other pair shares min(n - u, m - v) shingles at most, less one
    for every bit that a sketch of the other shingles has on one side only. A document so bounded meets
    partners of up to (n - u) * 100 / percent - u shingles only; bands are divided by the sizes of both
    sides, so that others are not even looked at.
    """
    shingles = _exploded(docs, mixed.select("rid").distinct(), k)
    # A shingle of one document only is rare and tells no pair: it counts, but needn't be kept.
    counted = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > 1)
    flagged = cut_lineage(shingles.join(counted, "shingle"), "flagged")
    hashed = F.xxhash64("shingle")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(shingle), 8), 64) AS int))")
    words = [F.bit_or(F.when(F.pmod(hashed, F.lit(4)) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{w}") for w in range(4)]
    own = flagged.where(F.col("holders") > RARE).groupBy("rid").agg(F.count(F.lit(1)).alias("common"), *words)
    rare = flagged.where(F.col("holders") <= RARE).select("rid", "shingle")
    of = mixed.select("rid", "part").distinct()
    holders = (
        rare.join(of, "rid").groupBy("shingle")
        .agg(F.collect_list(F.struct("rid", "part")).alias("h"), F.min("part").alias("low"), F.max("part").alias("high"))  # RARE at most
        .where("low < high").select("h", F.explode("h").alias("x")).select("x", F.explode("h").alias("y")).where("x.rid < y.rid AND x.part <> y.part")
    )
    by_shingle = holders.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))

    sketch_of = [f"s{w}" for w in range(4)]
    sizes = mixed.select("rid").distinct().join(reps.select("rid", F.col("n_shingles").alias("n")), "rid").join(own, "rid", "left").select(
        "rid", "n", (F.col("n") - F.coalesce("common", F.lit(0))).alias("u"), *(F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in sketch_of))
    rows = mixed.join(sizes, "rid")
    most = F.least(F.col("n") * 100 / percent, (F.col("n") - F.col("u")) * 100 / percent - F.col("u"))
    cell = lambda size: F.floor(F.ln(F.greatest(size.cast("double"), F.lit(1.0))) / F.lit(float(np.log(1.1)))).cast("int")
    ranged = rows.select("key", "rid", "part", "n", "u", *sketch_of, cell(F.col("n")).alias("own"), cell(F.col("n") * percent / 100).alias("low"), cell(most).alias("high"))
    # The larger document waits in a cell per possible size of the smaller one, and the other way round.
    larger = ranged.withColumn("high", F.least("own", "high")).where("low <= high").select(
        "key", F.col("own").alias("large"), F.explode(F.sequence("low", "high")).alias("small"),
        F.col("rid").alias("a"), F.col("part").alias("part_a"), F.col("n").alias("n_a"), F.col("u").alias("u_a"), *(F.col(w).alias(f"{w}_a") for w in sketch_of))
    smaller = ranged.where("own <= high").select(
        "key", F.explode(F.sequence("own", "high")).alias("large"), F.col("own").alias("small"),
        F.col("rid").alias("b"), F.col("part").alias("part_b"), F.col("n").alias("n_b"), F.col("u").alias("u_b"), *(F.col(w).alias(f"{w}_b") for w in sketch_of))
    only = lambda x, y: " + ".join(f"bit_count({w}_{x} & ~{w}_{y})" for w in sketch_of)
    shared = f"least(n_a - u_a - ({only('a', 'b')}), n_b - u_b - ({only('b', 'a')}))"
    met = larger.join(smaller, ["key", "large", "small"]).where(
        f"part_a <> part_b AND (n_b < n_a OR (n_b = n_a AND b < a)) AND 100 * {shared} >= {percent} * (n_a + n_b - {shared})")
    pairs = met.select("a", "b").unionByName(by_shingle).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = cut_lineage(pairs.distinct(), "across")
    discard(flagged)
    return found


def _exploded(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rid, shingle) of the rows numbered in ``wanted``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            if sets:
                rid = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.concatenate(sets))], names=["rid", "shingle"])

    return _sets(docs, wanted, k).mapInArrow(tidy(explode), "rid long, shingle long")


def _confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) ``pairs`` of row numbers whose full sets are similar.

    Every text is read once and sent to the stars it belongs to; a star's leader comes first and its set
    stays in memory while the members stream by. Stars of over STAR members are split and the leader
    copied.
    """
    pairs = cut_lineage(pairs, "pairs")
    large = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STAR)  # summed before they meet
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(float(STAR))), F.lit(1))
    sized = pairs.join(_light(cut_lineage(large, "large-stars"), 64), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    sized = cut_lineage(sized, "stars")
    roles = cut_lineage(
        sized.select(F.col("a").alias("rid"), "a", "part", F.lit(0).alias("role")).distinct()
        .unionByName(sized.select(F.col("b").alias("rid"), "a", "part", F.lit(1).alias("role"))), "roles")
    sets = _sets(docs, roles.select("rid").distinct(), k)
    stars = sets.join(roles, "rid").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, leader = None, None
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for a, rid, role, shingles in zip(*columns, strict=True):
                own = np.frombuffer(shingles, np.uint64)
                if role == 0:
                    star, leader = a, own
                elif a == star and similar(leader, own, percent):
                    found.append((a, rid))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], schema=schema)

    return stars.select("a", "rid", "role", "shingles").mapInArrow(tidy(run), "a long, b long")


def link(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``.

    Rows are linked when 100 * common shingles >= percent * all shingles; ``component_id`` is the smallest
    id reachable by links, ``kept`` says it is the row's own. A text without words has no shingles, no
    links and its own id. Rows with equal sets are one class, whatever their number. Rows without an id
    take part, but don't give their component its id unless none has one; of rows that repeat an id
    all are kept if the id is the smallest. Other columns are ignored.
    """
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "documents")
    return _linked(rows, _sketched(rows, k), k, percent).select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("kept"))


def _sketched(rows: DataFrame, k: int) -> DataFrame:
    """The written sketches of numbered rows."""

    def make():
        def work(texts: list) -> dict:
            out: dict = {"n_shingles": [], "one": [], "two": [], "registers": []}
            for t in texts:
                s = shingle_set(t, k)
                out["n_shingles"].append(len(s))
                out["one"].append(int(signed(s.sum(dtype=np.uint64).reshape(1))[0]))
                out["two"].append(int(signed(mix(s ^ _STEP).sum(dtype=np.uint64).reshape(1))[0]))
                out["registers"].append(sketch(s).tobytes() if len(s) else None)
            return out
        return work

    stats = per_text(rows, ["rid", "id"], "text", make, "n_shingles long, one long, two long, registers binary")
    return cut_lineage(stats, "sketches")


def _linked(rows: DataFrame, stats: DataFrame, k: int, percent: int) -> DataFrame:
    """(rid, id, n_shingles, component, kept)."""
    filled = stats.where("n_shingles > 0")
    classes = cut_lineage(
        filled.groupBy("n_shingles", "one", "two").agg(F.min("rid").alias("rep"), F.min("id").alias("least")), "classes")
    reps = cut_lineage(filled.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "n_shingles", "registers"), "reps")

    def make():
        return lambda rows: {"keys": [bands(np.frombuffer(r, np.uint16)).tolist() for r in rows]}

    every = cut_lineage(per_text(reps, ["rid"], "registers", make, "keys array<long>").select("rid", F.explode("keys").alias("key")), "bands")
    # Bands of one document link nothing. The others make a document the more central, the more they hold;
    # the most central one leads a band, so that most of a group meets the same few leaders.
    counts = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut_lineage(every.join(counts, "key"), "held-bands")
    discard(every)
    weight = held.groupBy("rid").agg((F.sum("n") * 1024 + F.pmod(F.xxhash64("rid"), F.lit(1024))).alias("weight"))
    keys = cut_lineage(held.select("key", "rid").join(weight, "rid"), "shared-bands")
    discard(held)
    leaders = keys.groupBy("key").agg(F.max_by("rid", "weight").alias("a"))
    led = (
        keys.join(leaders, "key").where("rid <> a").groupBy("a", F.col("rid").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    best = Window.partitionBy("b").orderBy(F.col("shared").desc(), "a")
    first = led.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADERS).select("a", "b")
    links = cut_lineage(_confirm(rows, _weighed(first, reps, percent), k, percent), "links")
    part = cut_lineage(components(links), "parts")

    mixed = _mixed(keys, part)
    across = _across(rows, mixed, reps, k, percent)
    more = cut_lineage(_confirm(rows, _weighed(across, reps, percent), k, percent), "links")
    discard(reps)
    if more.limit(1).count():
        # Only whole components meet now: their links are few, whatever the components' sizes.
        of = mixed.select("rid", "part").distinct()
        joined = more.join(of.select(F.col("rid").alias("a"), F.col("part").alias("x")), "a").join(
            of.select(F.col("rid").alias("b"), F.col("part").alias("y")), "b")
        over = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))
        part = part.unionByName(over.select("node", F.col("node").alias("component"))).distinct().join(
            over.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left"
        ).select("node", F.coalesce("over", "component").alias("component"))

    of_class = classes.join(part.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n_shingles", "one", "two", "least", F.coalesce("component", "rep").alias("part"))
    named = of_class.groupBy("part").agg(F.min("least").alias("component"))
    of_class = of_class.join(named, "part").select("n_shingles", "one", "two", "component")
    # Rows without shingles have no class and so no component of another row.
    joined = stats.select("rid", "id", "n_shingles", "one", "two").join(of_class, ["n_shingles", "one", "two"], "left")
    component = F.coalesce("component", "id")
    return joined.select("rid", "id", "n_shingles", component.alias("component"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _weighed(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose collision-corrected estimate comes near the threshold."""
    least = percent / 100 - SLACK
    sketches = pairs.join(reps.select(F.col("rid").alias("a"), F.col("registers").alias("ra")), "a").join(
        reps.select(F.col("rid").alias("b"), F.col("registers").alias("rb")), "b").select("a", "b", "rb", "ra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                near = pa.array(estimate(ra, rb) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in range(2)], names=["a", "b"])

    return sketches.mapInArrow(tidy(run), "a long, b long")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of least id (and least number)."""
    (rid,) = free_names(docs, "rid")
    rows = numbered(docs, "documents", rid)
    k, percent = options.get("k", SHINGLE), options.get("percent", PERCENT)
    texts = rows.select(F.col(rid).alias("rid"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    found = _linked(texts, _sketched(texts, k), k, percent).where("kept")
    place = Window.partitionBy("component").orderBy("rid")
    lone = found.where("n_shingles = 0 OR component IS NULL").select("rid")
    one = found.where("n_shingles > 0 AND component IS NOT NULL").withColumn("place", F.row_number().over(place)).where("place = 1").select("rid")
    kept = cut_lineage(lone.unionByName(one), "kept").withColumnRenamed("rid", rid)
    return rows.join(kept, rid, "left_semi").select(*map(quoted, docs.columns))


def op8_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at five words and a similarity of 0.75."""
    return link(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, unnest(s) AS x FROM sets),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  WITH RECURSIVE r(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, links.b FROM r JOIN links ON links.a = r.other
  ) SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN reach USING (doc_id)
"""
