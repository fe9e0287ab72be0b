"""Alignment of two tokenizers: which tokens of A and B cover the same bytes, and how usual each pair is.

Byte offsets at which a token of A and one of B both end cut a text into groups; all pairs of a group are
linked. Fast path: an array maps every A id to the B id of the same bytes, and links of such pairs are
counted in vectors of the vocabulary's length. Only the other pairs are counted by a shuffle, one row
per pair and chunk of texts. Counts go back to the chunks in the same form: each chunk receives those
of its own pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from signalpact.llm.text import bound_batches, narrow, slices, table, tidy
from signalpact.session import cut_lineage

#: Characters of the texts whose pairs are numbered and counted together; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Characters that are tokenised at once.
SLICE = 1 << 19
#: Words kept with their A ids per Python worker.
CACHE = 200_000
#: From here on the regex module's Unicode tables may differ from those of the tokenizers library.
_HIGH = re.compile("[\u0530-\U0010ffff]")
_STATS = ("n_a", "n_b", "n_groups", "n_links")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def default_pattern() -> str:
    """How a byte-level tokenizer splits a text into words."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _letters() -> dict[str, int]:
    """Byte of each character that a byte-level vocabulary writes: printable Latin-1 stands for itself, the
    other bytes in turn for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of consecutive blocks: the block of every item and its place in it."""
    block = np.repeat(np.arange(len(counts)), counts)
    return block, np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)


def _spelled(ids: list[np.ndarray], flat: np.ndarray, size: np.ndarray) -> Iterator[bytes]:
    """The bytes of each text's tokens; ``flat`` has those of all tokens end to end, ``size`` how many each has."""
    every = np.concatenate([np.empty(0, np.int32), *ids])
    own = size[every]
    upto = np.append(0, np.cumsum(own))
    data = flat[np.arange(upto[-1]) + np.repeat((np.cumsum(size) - size)[every] - upto[:-1], own)].tobytes()
    cuts = upto[np.cumsum([0, *map(len, ids)])].tolist()
    return (data[i:j] for i, j in zip(cuts, cuts[1:], strict=False))


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and ``same``: the B id with the bytes of an A id, or -1."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocab = _letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # Of pieces with equal bytes the byte fallback yields to the ordinary one.
        whole = {x: i for i, x in sorted(enumerate(self.b_bytes), key=lambda e: (not self.b.is_byte(e[0]), -e[0]))
                 if not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([whole.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.width = len(self.b_bytes)
        self.group_of = np.array([f"{a}|{b}" for a, b in enumerate(self.same.tolist())], object)
        self.told = np.array([str(i) for i in range(max(len(self.a_bytes), self.width))], object)
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(own), np.uint8) for own in (self.a_bytes, self.b_bytes))
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        by_word = (spec["model"]["type"] == "BPE" and not spec["normalizer"] and before.get("type") == "ByteLevel"
                   and before.get("use_regex", True) and not before["add_prefix_space"])
        self.split = re.compile(narrow(default_pattern())).findall if by_word else None
        self.words: dict[str, bytes] = {}

    def _a_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids by A. It never joins across the words its pattern yields, so each distinct word is encoded once."""
        out: list = [None] * len(texts)
        split = {i: self.split(t) for i, t in enumerate(texts) if self.split and (t.isascii() or not _HIGH.search(t))}
        whole = [i for i in range(len(texts)) if i not in split]
        if len(self.words) > CACHE:
            self.words = {}
        fresh = list(set().union(*split.values()).difference(self.words))
        for word, code in zip(fresh, self.a.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.words[word] = array("i", code.ids).tobytes()
        for i, words in split.items():
            out[i] = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4")
        for i, code in zip(whole, self.a.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(code.ids, "<i4")
        return out

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and B of each text; none if the text is null or empty, or either's bytes are not the text's."""
        there = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in there]
        none = np.empty(0, np.int32)
        a_ids, b_ids = [none] * len(texts), [none] * len(texts)
        coded_a = self._a_ids(spaced)
        coded_b = [np.array(b, np.int32) for b in self.b.encode([texts[i] for i in there], num_threads=1)]
        read = zip(_spelled(coded_a, self.a_flat, self.a_size), _spelled(coded_b, self.b_flat, self.b_size), strict=True)
        for i, text, a, b, (by_a, by_b) in zip(there, spaced, coded_a, coded_b, read, strict=True):
            if by_a == text.encode() == by_b:
                a_ids[i], b_ids[i] = a, b
        return a_ids, b_ids

    def align(self, texts: list[str | None]) -> Aligned:
        return Aligned(self, *self.encode(texts))


class Aligned:
    """Groups and links of some texts, laid end to end: all their tokens are cut at once, as both end with each text."""

    def __init__(self, vocabularies: Vocabularies, a_ids: list[np.ndarray], b_ids: list[np.ndarray]):
        v, self.v = vocabularies, vocabularies
        self.n_a, self.n_b = (np.array([len(x) for x in own], np.int64) for own in (a_ids, b_ids))
        self.a, self.b = (np.concatenate([np.empty(0, np.int32), *own]).astype(np.int64) for own in (a_ids, b_ids))
        a_ends, b_ends = np.cumsum(v.a_size[self.a]), np.cumsum(v.b_size[self.b])
        ends = np.zeros((2, max([0, *a_ends[-1:], *b_ends[-1:]]) + 1), bool)
        ends[0, a_ends] = ends[1, b_ends] = True
        cuts = np.flatnonzero(ends[0] & ends[1])
        self.a_to, self.b_to = (np.searchsorted(ends, cuts, side="right") for ends in (a_ends, b_ends))
        self.in_a, self.in_b = (np.diff(to, prepend=0) for to in (self.a_to, self.b_to))
        a_doc, _ = _blocks(self.n_a)
        self.doc = a_doc[self.a_to - 1]
        self.n_groups = np.bincount(self.doc, minlength=len(self.n_a))
        self.n_links = np.bincount(self.doc, self.in_a * self.in_b, len(self.n_a)).astype(np.int64)
        first_a, first_b = self.a[self.a_to - self.in_a], self.b[self.b_to - self.in_b]
        self.exact = (self.in_a == 1) & (self.in_b == 1) & (v.same[first_a] == first_b)
        self.first_a = first_a

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, A id) of all links of equal bytes, and (text, A id * width + B id) of all others."""
        rest = np.flatnonzero(~self.exact)
        group, place = _blocks(self.in_a[rest] * self.in_b[rest])
        at = rest[group]
        a = self.a[(self.a_to - self.in_a)[at] + place // self.in_b[at]]
        b = self.b[(self.b_to - self.in_b)[at] + place % self.in_b[at]]
        doc, equal = self.doc[at], self.v.same[a] == b
        return (np.concatenate([self.doc[self.exact], doc[equal]]), np.concatenate([self.first_a[self.exact], a[equal]]),
                doc[~equal], a[~equal] * self.v.width + b[~equal])

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per text, an empty string without tokens."""
        told = np.empty(len(self.exact), object)
        told[self.exact] = self.v.group_of[self.first_a[self.exact]]
        rest = np.flatnonzero(~self.exact)
        a_all, b_all = self.v.told[self.a].tolist(), self.v.told[self.b].tolist()
        spans = ((to - n)[rest].tolist() for to, n in ((self.a_to, self.in_a), (self.b_to, self.in_b)))
        told[rest] = [
            f"{','.join(a_all[i:j])}|{','.join(b_all[k:m])}"
            for (i, k), j, m in zip(zip(*spans, strict=True), self.a_to[rest].tolist(), self.b_to[rest].tolist(), strict=True)
        ]
        told = told.tolist()
        ends = np.cumsum(self.n_groups).tolist()
        return [";".join(told[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _held(doc: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key), in order, with how often each occurs; keys are below ``width``."""
    both = np.sort(doc * width + key)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[:len(both)])
    return both[at] // width, both[at] % width, np.diff(at, append=len(both))


def _sparse(docs: int, doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> bytes:
    """Keys per text and their multiplicities: counts, then steps between keys, then multiplicities."""
    first = np.append(True, doc[1:] != doc[:-1])[:len(doc)]
    return _packed(np.concatenate([np.bincount(doc, minlength=docs), np.where(first, key, np.diff(key, prepend=0)), times]))


def _dense(docs: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`_sparse` was given, with counts per text in place of the texts."""
    values = _unpacked(data)
    counts, rest = values[:docs], values[docs:]
    step, times = rest[:len(rest) // 2], rest[len(rest) // 2:]
    total = np.append(0, np.cumsum(step))
    doc, _ = _blocks(counts)
    return counts, total[1:] - total[(np.cumsum(counts) - counts)[doc]], times


def _sums(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive blocks."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _chunk_schema(docs: DataFrame, id_col: str) -> str:
    kind = docs.schema[id_col].dataType.simpleString()
    stats = ", ".join(f"{n} array<long>" for n in _STATS)
    return (f"chunk long, ids array<{kind}>, {stats}, groups array<string>, equal binary, other binary, "
            "vec_a array<int>, vec_n array<int>, pair_a array<int>, pair_b array<int>, pair_n array<int>")


def _chunks(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, digest: bool) -> DataFrame:
    """The written chunks: per text its counts and links, per chunk its pairs with the texts that hold them."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = _chunk_schema(rows, "id")
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
    most, piece = CHUNK, SLICE

    def chunk(v: Vocabularies, key: int, ids: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
        stats: dict[str, list] = {n: [] for n in _STATS}
        groups: list[str] = []
        found: list[list[np.ndarray]] = [[], [], [], []]
        for some in slices(texts, piece):
            aligned = v.align(texts[some])
            for n in _STATS:
                stats[n].append(getattr(aligned, n))
            for told in aligned.groups():
                groups.append(hashlib.sha256(told.encode()).hexdigest() if digest and told else told)
            equal_doc, equal, other_doc, other = aligned.links()
            for into, part in zip(found, (equal_doc + some.start, equal, other_doc + some.start, other), strict=True):
                into.append(part)
        equal_doc, equal, other_doc, other = (np.concatenate(x) for x in found)
        n = len(texts)
        doc, a, times = _held(equal_doc, equal, len(v.a_bytes))
        vector = np.bincount(a, minlength=len(v.a_bytes))  # texts that hold A id and its equal, linked
        vec_a = np.flatnonzero(vector)
        pairs, number = np.unique(other, return_inverse=True)
        other_held = _held(other_doc, number, max(1, len(pairs)))
        row = {
            "chunk": pa.array([key]), "ids": pa.ListArray.from_arrays([0, n], pa.concat_arrays(ids)),
            **{s: pa.array([np.concatenate(x)]) for s, x in stats.items()}, "groups": pa.array([groups], pa.list_(pa.string())),
            "equal": pa.array([_sparse(n, doc, a, times)]), "other": pa.array([_sparse(n, *other_held)]),
            "vec_a": pa.array([vec_a]), "vec_n": pa.array([vector[vec_a]]),
            "pair_a": pa.array([pairs // v.width]), "pair_b": pa.array([pairs % v.width]),
            "pair_n": pa.array([np.bincount(other_held[1], minlength=len(pairs))]),
        }
        return pa.RecordBatch.from_arrays([row[f.name].cast(f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, key = Vocabularies(a_path, b_path), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            column = batch.column(1).to_pylist()
            for some in slices(column, most):
                part = column[some]
                ids.append(batch.column(0).slice(some.start, len(part)))
                texts += part
                size += sum(len(t) for t in part if t)
                if size >= most:
                    yield chunk(v, key, ids, texts)
                    ids, texts, size, key = [], [], 0, key + 1
        if texts:
            yield chunk(v, key, ids, texts)

    return cut_lineage(rows.mapInArrow(tidy(run), ddl), "aligned")


def _vector(counted: DataFrame, width: int) -> np.ndarray:
    """(a, n) rows as a vector of the vocabulary's length."""
    out = np.zeros(width, np.int64)
    for r in counted.collect():  # one row per A id at most
        out[r.a] = r.n
    return out


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
    digest: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    A (byte-level BPE) reads a space and the text, B (sentencepiece) the text, before which it puts a space
    itself. A pair's count is the number of texts that hold it linked; ``count_sum`` adds it up over the
    links of a text, ``n_best`` counts links whose pair has the highest count of its A id (ties included).
    ``groups`` is the alignment, ``a1,a2|b1;a3|b2,b3`` (its SHA-256 with ``digest``; an empty string stays).

    Texts that are null or empty, or that either tokenizer does not give back byte for byte, have no
    tokens: zeros and an empty string. Strings of special tokens are plain text. Repeated rows and ids
    count one by one; a null id stays null; an empty table gives no rows; other columns are ignored.

    What is collected are vectors with one number per A id. Pairs are shuffled once per chunk that holds
    them, however many of its texts do, so a usual pair is one row of a chunk among its many.
    """
    default = default_paths()
    a_path, b_path = a_path or default[0], b_path or default[1]
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = _chunks(docs, id_col, text_col, a_path, b_path, digest)
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("i", "p")).select(
        "chunk", "i", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").cast("long").alias("n"))
    counts = cut_lineage(listed.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    exact = chunks.select(F.explode(F.arrays_zip("vec_a", "vec_n")).alias("v")).groupBy(F.col("v.vec_a").alias("a")).agg(
        F.sum(F.col("v.vec_n").cast("long")).alias("n"))
    width = len(Vocabularies(a_path, b_path).a_bytes)
    equal_n = _vector(exact, width)
    best = np.maximum(equal_n, _vector(counts.groupBy("a").agg(F.max("n").alias("n")), width))

    back = listed.select("chunk", "i", "a", "b").join(counts, ["a", "b"]).groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct("i", "a", "n"))).alias("counts"))  # the pairs of one chunk
    joined = chunks.join(back, "chunk", "left").select(
        "ids", *_STATS, "groups", "equal", "other", F.col("counts.a").alias("a"), F.col("counts.n").alias("n"))
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in (*_STATS, "n_best", "count_sum")) + ", groups string"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0).slice(r, 1).flatten()
                docs_n = len(ids)
                held = [batch.column(k).slice(r, 1).flatten().to_numpy(zero_copy_only=False) for k in (8, 9)]
                total, top = np.zeros(docs_n, np.int64), np.zeros(docs_n, np.int64)
                for column, of, n_of in ((6, np.arange(width), equal_n), (7, *held)):
                    counts, key, times = _dense(docs_n, batch.column(column)[r].as_py())
                    n = n_of[key]
                    total += _sums(counts, n * times)
                    top += _sums(counts, np.where(n == best[of[key]], times, 0))
                columns = [ids, *(batch.column(k).slice(r, 1).flatten() for k in range(1, 5)), pa.array(top), pa.array(total),
                           batch.column(5).slice(r, 1).flatten()]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return joined.mapInArrow(tidy(run), schema)


def op12_identity_map_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the default tokenizers; the alignment as its digest."""
    return align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
