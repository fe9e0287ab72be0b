"""Substring dedup: seed with winnowed anchors, extend both ways, drop maximal repeats.

Every window of LENGTH words selects one anchor: the rightmost least hash among its SEED-word grams. Equal
windows select equal anchors at the same place, so documents that share a window meet in its anchor.

An anchor is first extended as far as the windows that selected it reach, to the left and to the right
together. Occurrences whose widest extension is equal to an earlier one repeat it whole. Only where an
anchor is shared but the widest extensions differ (at the ends of a passage, at an edit) are the shorter
extensions, one per window, compared. No pair of documents is ever listed: an occurrence is compared with
the first of its kind. Overlapping repeats merge into maximal ones, which are removed from the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalpact.llm.text import (
    Spans, bound_batches, free_names, gram_hashes, mix, numbered, per_text, quoted, signed, slices, table, text_bytes, tidy, word_hashes,
    word_table,
)
from signalpact.session import cut_lineage

#: Words of a window: the shortest repeat that is removed.
LENGTH = 20
#: Words of a seed. A window holds LENGTH - SEED + 1 seeds and always selects one of them.
SEED = 8
#: Bytes of shared anchors that are sent to every task to be looked at again; beyond it they are joined.
BROADCAST_BYTES = 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def anchors(words: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(hash of the seed, hash of the widest extension, first window, last window) per anchor of a text.

    The windows first..last are those that selected the anchor; they are consecutive.
    """
    n = len(words) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = gram_hashes(words, seed)
    width, m = length - seed + 1, len(grams)
    back = np.lib.stride_tricks.sliding_window_view(grams[::-1], width).argmin(axis=1)
    at = (m - 1 - (np.arange(n) + back))[::-1]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], n) - 1
    place = at[first]
    whole = Spans(words).hashes(first, last + length)
    return grams[place], mix(whole + (place - first).astype(np.uint64) * _STEP), first, last


def _runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge adjoining or overlapping window ranges of each document; input sorted by (doc, first)."""
    if not len(doc):
        return doc, first, last
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)
    heads = np.flatnonzero(new)
    return doc[heads], first[heads], np.maximum.reduceat(last, heads)


_SEEDED = pa.schema([("key", pa.int64()), ("wide", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()),
                     ("first", pa.int32()), ("last", pa.int32()), ("known", pa.bool_())])


def _seeds(length: int, seed: int):
    """Anchors of all texts of a task. Repeats within a batch are settled at once: the later ones become
    known ranges of their document and only the first occurrence goes on to meet other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids, texts = (batch.column(i) for i in range(3))
            rids, ids = rids.to_numpy(), ids.to_numpy()
            texts = texts.to_pylist()
            for part in slices(texts, 1 << 23):
                found = [anchors(word_hashes(text_bytes(t)), length, seed) for t in texts[part]]
                counts = [len(f[0]) for f in found]
                if not sum(counts):
                    continue
                key, wide, first, last = (np.concatenate([f[i] for f in found]) for i in range(4))
                row = np.repeat(np.arange(part.start, part.start + len(counts)), counts)
                order = np.lexsort((first, rids[row], ids[row], wide))
                later = np.zeros(len(row), bool)
                later[order[1:]] = wide[order[1:]] == wide[order[:-1]]
                seen = np.flatnonzero(later)
                rows, firsts, lasts = _runs(row[seen], first[seen], last[seen])
                new = np.flatnonzero(~later)
                salt = signed(mix(rids[rows].astype(np.uint64) * _STEP + firsts.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([signed(key[new]), salt])), pa.array(np.concatenate([signed(wide[new]), salt])),
                    pa.array(np.concatenate([ids[row[new]], ids[rows]])), pa.array(np.concatenate([rids[row[new]], rids[rows]])),
                    pa.array(np.concatenate([first[new], firsts]).astype(np.int32)),
                    pa.array(np.concatenate([last[new], lasts]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(new), bool), np.ones(len(rows), bool)])),
                ], schema=_SEEDED)
    return run


_WINDOWS = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("first", pa.int32())])


def _windows(length: int):
    """Both halves of a 128-bit hash of every window of the given ranges (shorter extensions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, ranges = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for part in slices(texts, 1 << 23):
                parts = []
                for i in range(part.start, part.stop):
                    words = word_hashes(text_bytes(texts[i]))
                    at = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges[i]]))
                    one = Spans(words).hashes(at, at + length)
                    two = Spans(mix(words ^ _STEP)).hashes(at, at + length)
                    parts.append((one, two, np.full(len(at), i), at))
                one, two, row, at = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(one)), pa.array(signed(two)), pa.array(ids[row]), pa.array(rids[row]),
                    pa.array(at.astype(np.int32))], schema=_WINDOWS)
    return run


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(rid, first, last): ranges of windows that repeat an earlier window, for (doc, rid, text) rows.

    Earlier means smaller (doc, rid), or an earlier start in the same row. ``doc`` and ``rid`` are bigints.
    """
    bound_batches(docs.sparkSession)
    seeded = docs.select("doc", "rid", "text").mapInArrow(
        tidy(_seeds(length, seed)), "key long, wide long, doc long, rid long, first int, last int, known boolean")
    same = Window.partitionBy("key", "wide").orderBy("doc", "rid", "first")
    group = Window.partitionBy("key")
    judged = (
        seeded.withColumn("place", F.row_number().over(same))
        .withColumns({"low": F.min("wide").over(group), "high": F.max("wide").over(group)})
        .select("doc", "rid", "first", "last", (F.col("known") | (F.col("place") > 1)).alias("known"), (F.col("low") < F.col("high")).alias("open"))
        .where("known OR open")
    )
    judged = cut_lineage(judged, "seeds")
    # One row per document, no longer than its own text.
    open_ = judged.where("NOT known").groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    count = judged.where("NOT known").count()
    small = 16 * count <= BROADCAST_BYTES
    texts = docs.join(F.broadcast(open_) if small else open_, "rid").select("doc", "rid", "text", "ranges")
    windows = texts.mapInArrow(tidy(_windows(length)), "one long, two long, doc long, rid long, first int")
    # An anchor's widest extension stands for all its copies within a batch, so a common window meets here once per batch.
    earlier = Window.partitionBy("one", "two").orderBy("doc", "rid", "first")
    again = windows.withColumn("place", F.row_number().over(earlier)).where("place > 1").select("rid", "first", F.col("first").alias("last"))
    return judged.where("known").select("rid", "first", "last").unionByName(again)


def removed(n_words: int, ranges: list | None, length: int = LENGTH) -> np.ndarray:
    """Which words the windows of the ranges cover."""
    cover = np.zeros(n_words + 1, np.int32)
    if ranges:
        np.add.at(cover, [r["first"] for r in ranges], 1)
        np.add.at(cover, [r["last"] + length for r in ranges], -1)
    return np.cumsum(cover[:-1]) > 0


def _marked(docs: DataFrame, id_col: str, text_col: str, length: int, seed: int) -> DataFrame:
    """``docs`` with a last column of ranges. Most documents have some, so the marks are joined, not broadcast."""
    key = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit((1 << 63) - 1))
    number, name = free_names(docs, "_rid", "_ranges")
    rows = numbered(docs, "documents", number)
    marks = cut_lineage(
        repeats(rows.select(key.alias("doc"), F.col(number).alias("rid"), F.col(quoted(text_col)).alias("text")), length, seed), "repeats")
    ranges = marks.groupBy(F.col("rid").alias(number)).agg(F.collect_list(F.struct("first", "last")).alias(name))
    return rows.join(ranges.hint("merge"), number, "left").drop(number)


def kept_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row of ``docs``.

    A word is removed if a window of ``length`` words that covers it also starts earlier: in a row of
    smaller id, or earlier in the same row. Windows are judged on the input. Rows that repeat an id count
    as documents in the order they are stored (files by path); rows without an id come last. A null or short text keeps
    all its words. Other columns are ignored.
    """
    whole = _marked(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col, length, seed)
    both = whole.select(quoted(id_col), F.struct(F.col(quoted(text_col)).alias("text"), F.col(whole.columns[-1]).alias("ranges")).alias("_both"))

    def make():
        def work(rows: list) -> dict:
            out: dict = {"n_words": [], "n_removed": [], "kept_sha256": []}
            for row in rows:
                words = text_bytes(row["text"]).split()
                gone = removed(len(words), row["ranges"], length)
                kept = [words[i] for i in np.flatnonzero(~gone)] if gone.any() else words
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            return out
        return work

    return per_text(both, [id_col], "_both", make, "n_words long, n_removed long, kept_sha256 string")


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED,
) -> DataFrame:
    """``docs`` with the repeated words cut out of the text; white space around kept words stays as it is.

    All rows and columns stay. See :func:`kept_digests` for what is removed; a text without repeats is
    unchanged, a null stays null, a text of repeats only becomes empty.
    """
    others = [c for c in docs.columns if c != text_col]
    whole = _marked(docs, id_col, text_col, length, seed)
    pair, clean = free_names(docs, "_both", "_clean")
    both = whole.select(*map(quoted, others), F.struct(F.col(quoted(text_col)).alias("text"), F.col(whole.columns[-1]).alias("ranges")).alias(pair))

    def make():
        def work(rows: list) -> dict:
            return {clean: [cut(row["text"], row["ranges"], length) for row in rows]}
        return work

    out = per_text(both, others, pair, make, f"{clean} string")
    return out.withColumnRenamed(clean, text_col).select(*map(quoted, docs.columns))


def cut(text: str | None, ranges: list | None, length: int = LENGTH) -> str | None:
    """The text without the words of the ranges and the white space before each of them."""
    if not ranges:
        return text
    data = text_bytes(text)
    _, starts, ends = word_table(data)
    gone = removed(len(starts), ranges, length)
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(data[at:ends[a - 1] if a else 0])
        at = int(ends[b - 1])
    out.append(data[at:])
    return b"".join(out).decode()


def op4_seed_extend_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents without their repeats of 20 words and more."""
    return kept_digests(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS x
  FROM words WHERE len(w) >= 20
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT doc_id, list(DISTINCT j) AS g FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM again) GROUP BY doc_id
), numbered AS (
  SELECT doc_id, j, word FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM words)
), dropped AS (
  SELECT doc_id, unnest(g) AS j FROM gone
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k, count(*) AS n FROM numbered ANTI JOIN dropped USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
