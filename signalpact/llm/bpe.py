"""Byte-level BPE encoding and decoding with segment trees over byte positions.

A leaf holds the rank of the pair that starts at its position (the live part there and the next live
part); the root holds the leftmost minimum. A merge takes the root's pair, joins the two parts and
updates three leaves: the joined part, its left neighbour and the position that died. Short pieces are
merged side by side, one tree per row of a numpy table; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from signalpact.llm.text import per_text, slices, table

#: Pieces up to this many bytes are merged side by side.
SHORT = 64
#: Pieces kept with their ids per Python worker.
CACHE = 200_000
#: Rank of pairs that don't merge: beyond every rank, and times SHORT it still fits 32 bits.
NEVER = 1 << 24


class PairTable:
    """Ranks of pairs of ids as a hash table that numpy probes for many pairs at once."""

    def __init__(self, pairs: dict[int, int], width: int):
        self.width = width  # a pair's key is left * width + right
        size = 1 << (2 * len(pairs) - 1).bit_length() + 1
        self.mask = size - 1
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
        todo_keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        todo_ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slot(todo_keys)
        while len(todo_keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.ranks[at[won]] = todo_keys[won], todo_ranks[won]
            rest = np.ones(len(todo_keys), bool)
            rest[won] = False
            todo_keys, todo_ranks, at = todo_keys[rest], todo_ranks[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(20)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NEVER where they don't merge or either is negative."""
        keys = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.width + right)
        at = self._slot(keys)
        out = np.full(len(keys), NEVER, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (found >= 0)
            open_, at = open_[go], (at[go] + 1) & self.mask
        return out


class Ranks:
    """A rank file (base64 token, rank per line) as lookup tables."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.width = max(self.tokens) + 1
        self.pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        self.rank = PairTable(self.pairs, self.width).rank


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece of any length, by a segment tree of its own."""
    n = len(piece)
    parts = [int(ranks.byte[b]) for b in piece]
    size = 1 << max(1, (n - 1).bit_length())
    worst = (NEVER, n)
    tree = [worst] * (2 * size)
    pairs, width = ranks.pairs, ranks.width
    for i in range(n - 1):
        rank = pairs.get(parts[i] * width + parts[i + 1])
        if rank is not None:
            tree[size + i] = (rank, i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: tuple[int, int]) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                return
            tree[i] = best
            i >>= 1

    def pair(i: int) -> tuple[int, int]:
        j = after[i]
        rank = pairs.get(parts[i] * width + parts[j]) if j < n else None
        return worst if rank is None else (rank, i)

    while tree[1][0] < NEVER:
        rank, i = tree[1]
        j = after[i]
        parts[i], after[i] = rank, after[j]
        if after[j] < n:
            before[after[j]] = i
        parts[j] = -1
        put(j, worst)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [p for p in parts if p >= 0]


def merge_short(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Ids of many pieces of 2 to SHORT bytes each, one tree per row."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    size = 1 << int(lengths.max() - 1).bit_length()
    count = len(pieces)
    rows = np.repeat(np.arange(count), lengths)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    parts = np.full((count, size + 1), -1, np.int32)
    parts[rows, at] = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    places = np.arange(size)
    worst = np.int32(NEVER * size)
    # A leaf packs rank and position, so that the least value is the leftmost least rank.
    tree = np.full((count, 2 * size), worst, np.int32)
    inner = ranks.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(count, size)
    tree[:, size:] = np.where(inner < NEVER, inner * size + places, worst)
    level = size
    while level > 1:
        level >>= 1
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
    after = np.tile(np.arange(1, size + 2), (count, 1))
    after = np.minimum(after, lengths[:, None])
    before = np.tile(np.arange(-1, size), (count, 1))
    live = np.flatnonzero(tree[:, 1] < worst)

    def put(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        node = place + size
        tree[row, node] = value
        while True:
            node = node >> 1
            if not node[0]:
                return
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair(row: np.ndarray, place: np.ndarray) -> np.ndarray:
        nxt = after[row, place]
        right = np.where(nxt < lengths[row], parts[row, nxt], -1)
        rank = ranks.rank(parts[row, place], right)
        return np.where(rank < NEVER, rank * size + place, worst)

    while len(live):
        top = tree[live, 1]
        i = top % size
        j = after[live, i]
        parts[live, i] = top // size
        beyond = after[live, j]
        after[live, i] = beyond
        before[live, beyond] = i
        parts[live, j] = -1
        put(live, j, np.full(len(live), worst))
        put(live, i, pair(live, i))
        left = before[live, i]
        has = np.flatnonzero(left >= 0)
        if len(has):
            put(live[has], left[has], pair(live[has], left[has]))
        live = live[tree[live, 1] < worst]
    kept = parts[:, :size] >= 0
    ids = parts[:, :size][kept].tolist()
    ends = np.cumsum(kept.sum(axis=1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode_pieces(pieces: list[str], ranks: Ranks) -> list[list[int]]:
    """Ids of distinct pieces: a piece that is a token is that token, else its merges."""
    out: list = [None] * len(pieces)
    groups: dict[int, list[int]] = {}
    raw = [p.encode("utf-8") for p in pieces]
    for i, piece in enumerate(raw):
        whole = ranks.ids.get(piece)
        if whole is not None:
            out[i] = [whole]
        elif len(piece) > SHORT:
            out[i] = merge_long(piece, ranks)
        else:
            groups.setdefault((len(piece) - 1).bit_length(), []).append(i)
    for group in groups.values():
        for k in range(0, len(group), 4096):
            some = group[k:k + 4096]
            for i, ids in zip(some, merge_short([raw[i] for i in some], ranks), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Encodes whole texts; pieces seen lately are kept with their ids."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list) -> Iterator[list[int]]:
        """Ids of each text; a null is an empty text. New pieces of about 4 million characters are merged at once."""
        for part in slices(texts):
            split = [self.split(t) if t else [] for t in texts[part]]
            here = set().union(*split)
            fresh = list(here.difference(self.known))
            if fresh:
                if len(self.known) + len(fresh) > CACHE:
                    self.known = {p: self.known[p] for p in here.intersection(self.known)}
                self.known.update(zip(fresh, encode_pieces(fresh, self.ranks), strict=True))
            find = self.known.__getitem__
            for pieces in split:
                yield list(chain.from_iterable(map(find, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoder(path: str | None, pattern: str | None) -> Encoder:
    return Encoder(path or default_path(), pattern or default_pattern())


def encode_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """(id, ``ids`` array of int) per row. A null or empty text has no ids; rows are treated one by one."""

    def make():
        encoder = _encoder(path, pattern)
        return lambda texts: {"ids": list(encoder.encode(texts))}

    return per_text(docs, [id_col], text_col, make, "ids array<int>")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, ``text`` binary) per row of (id, ``ids``). Null ids decode to no bytes; an unknown id is an error."""

    def make():
        tokens = load(path or default_path()).tokens
        return lambda rows: {"text": [b"".join([tokens[i] for i in ids or []]) for ids in rows]}

    return per_text(encoded, [id_col], "ids", make, "text binary")


def encode_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """Encode and decode every whole text and return digests of both.

    Returns the id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256``
    (decoded bytes), one row per input row. A null text counts as empty: no ids, digests of no bytes.
    Repeated rows and ids are treated one by one; other columns are ignored. No shuffle; a task holds
    one batch, one text's ids and CACHE known pieces.
    """

    def make():
        encoder = _encoder(path, pattern)

        def work(texts: list) -> dict:
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in encoder.encode(texts):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            return out

        return work

    return per_text(docs, [id_col], text_col, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the public byte-level vocabulary and back."""
    return encode_digests(table(spark, sf_dir, "documents"))
