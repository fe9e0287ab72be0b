"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Pieces are dealt into bounded shards. Where best-fit decreasing needs no more bins than the tokens do, a
shard is done. In every other shard several islands evolve packings of its poorly filled bins: crossover
injects whole well-filled bins of one parent into the other, bins that hold a duplicate are dissolved, and
the displaced pieces first replace pieces that fill a bin less and then go where they fit best. After every
epoch each island receives the elite of its neighbour. The poorly filled bins of all shards are then dealt and packed once more, so what a shard
leaves open does not add up.
"""

from __future__ import annotations

import copy
import functools
import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpact.llm.bpe import NEVER, PairTable
from signalpact.llm.text import narrow, per_text, slices, table, word_table
from signalpact.session import cut_lineage

#: Tokens a sequence holds.
CAPACITY = 2048
#: Pieces of a shard on average: what one task packs at once.
SHARD = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 8, 8
#: Pieces that a search has to work with at least, where the poorly filled bins hold fewer.
CORE = 256
#: Items of a bin that a replacement considers, the largest first.
SWAPPED = 6
#: Bins at least this full are kept as they are; the others are packed again.
GOOD = 0.995
#: Words, and pieces of words, kept with their ids per Python worker.
CACHE = 300_000
#: Characters of text whose words are looked up at once.
AT_ONCE = 1 << 22
#: Bytes of a piece that is merged beside others.
SHORT = 32
_HIGH = re.compile("[\u0300-\U0010ffff]")


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some place of each distinct hash, and the number of each hash among them.

    Which of equal hashes stands for them is open, so the sort need not be a stable one.
    """
    order = np.argsort(hashes)
    there = hashes[order]
    new = np.append(True, there[1:] != there[:-1])[:len(there)]
    inverse = np.empty(len(hashes), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


class WordTokens:
    """Ids of whole texts as little-endian 32-bit bytes.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its words, and
    the distinct words of a few megabytes are looked up together. New words without characters from
    U+0300 on (which normalisation leaves alone) are split by the vocabulary's pattern and merged side by
    side from its merge list; all others go through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = re.compile(narrow(r"\n|" + pattern)).findall
        letters, end = _byte_letters(), model["end_of_word_suffix"]
        self.byte = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        width = max(vocab.values()) + 1
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        self.table = PairTable({vocab[a] * width + vocab[b]: i for i, (a, b) in enumerate(model["merges"])}, width)
        self.at_once, self.cache = AT_ONCE, CACHE
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Merge pieces of 1 to SHORT bytes side by side, in every step each row's leftmost best pair."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows = np.repeat(np.arange(len(pieces)), lengths)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((len(pieces), int(lengths.max()) + 1), -1, np.int32)
        ids[rows, at] = np.where(at == lengths[rows] - 1, self.last[codes], self.byte[codes])
        ranks = self.table.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        result = ids.copy()
        live = np.arange(len(pieces))
        places = np.arange(ids.shape[1])
        while len(live):
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(live)), best]
            done = rank >= NEVER
            if done.any():
                result[live[done]] = ids[done]
                go = ~done
                live, ids, ranks, best, rank = live[go], ids[go], ranks[go], best[go], rank[go]
                if not len(live):
                    break
            every = np.arange(len(live))
            shift = np.minimum(places + (places > best[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[:, -1] = -1
            ids[every, best] = self.merged[rank]
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], ranks.shape[1] - 1), axis=1)
            ranks[:, -1] = NEVER
            ranks[every, best] = self.table.rank(ids[every, best], ids[every, best + 1])
            left = np.maximum(best - 1, 0)
            before = self.table.rank(ids[every, left], ids[every, left + 1])
            ranks[every, left] = np.where(best > 0, before, ranks[every, left])
        kept = result >= 0
        flat = result[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(np.minimum(lengths, SHORT + 1).astype(np.uint8), kind="stable")  # a byte: sorted by counting
        short = int((lengths <= SHORT).sum())
        for k in range(0, short, 4096):
            some = order[k:min(k + 4096, short)].tolist()
            yield from zip([pieces[i] for i in some], self._merge([raw[i] for i in some]), strict=True)
        some = order[short:].tolist()
        if some:
            yield from zip([pieces[i] for i in some], self._library([pieces[i] for i in some]), strict=True)

    def _encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        text = b"\n".join(words).decode()
        if _HIGH.search(text):
            texts = text.split("\n")
            rare = [i for i, t in enumerate(texts) if not t.isascii() and _HIGH.search(t)]
            yield from zip([words[i] for i in rare], self._library([texts[i] for i in rare]), strict=True)
            for i in reversed(rare):
                del texts[i], words[i]
            text = "\n".join(texts)
        if not words:
            return
        split = self.split(text.lower() + "\n")  # a piece per part of a word, a line end after each word
        here = set(split)
        fresh = list(here.difference(self.pieces))
        if len(self.pieces) + len(fresh) > self.cache:
            self.pieces = {p: self.pieces[p] for p in here.intersection(self.pieces)}
        self.pieces["\n"] = b""
        self.pieces.update(self._encode_pieces([p for p in fresh if p != "\n"]))
        values = list(map(self.pieces.__getitem__, split))
        upto = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))
        ends = upto[np.flatnonzero(np.fromiter(map("\n".__eq__, split), bool, len(split)))].tolist()
        flat = b"".join(values)
        yield from zip(words, [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)

    def encode(self, texts: list) -> Iterator[bytes]:
        for part in slices(texts, self.at_once):
            rows = [b"" if not t else t.encode() if not t.isascii() and _HIGH.search(t) else t.lower().encode() for t in texts[part]]
            data = b"\n".join(rows)
            hashes, starts, ends = word_table(data)
            first, inverse = _distinct(hashes)
            words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            fresh = [w for w in words if w not in self.words]
            if fresh:
                if len(self.words) + len(fresh) > self.cache:
                    self.words = {w: self.words[w] for w in words if w in self.words}
                self.words.update(self._encode_words(fresh))
            values = list(map(self.words.__getitem__, words))
            counts = np.fromiter(map(len, values), np.int64, len(values)) // 4
            flat = np.frombuffer(b"".join(values), "<u4")
            each = counts[inverse]
            upto = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - (np.cumsum(counts) - counts)[inverse], each)]
            begins = np.cumsum([0, *(len(r) + 1 for r in rows)])
            cuts = upto[np.searchsorted(starts, begins)].tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield ids[a:b].tobytes()


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> WordTokens:
    return WordTokens(path)


def word_tokens(path: str, at_once: int = AT_ONCE, cache: int = CACHE) -> WordTokens:
    """The vocabulary, read once per Python worker, with tables of words that end with the task."""
    tokens = copy.copy(_vocabulary(path))
    tokens.at_once, tokens.cache = at_once, cache
    tokens.words, tokens.pieces = {}, {}
    return tokens


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    at_once: int = AT_ONCE, cache: int = CACHE,
) -> DataFrame:
    """Tokenise whole texts, close each with id 0 and cut those longer than ``capacity``.

    Returns (id, piece, start, length, ids_crc32). A null text is empty and has one piece of one id.
    ``at_once`` (characters) and ``cache`` (words) bound a worker's memory against its time, not the result.
    """

    def make():
        tokens = word_tokens(path or default_path(), at_once, cache)

        def work(texts: list) -> dict:
            out = []
            for ids in tokens.encode(texts):
                ids += b"\0\0\0\0"
                step = 4 * capacity
                out.append([{"start": i // 4, "length": len(ids[i:i + step]) // 4, "ids_crc32": zlib.crc32(ids[i:i + step])}
                            for i in range(0, len(ids), step)])
            return {"pieces": out}

        return work

    cut = per_text(docs, [id_col], text_col, make, "pieces array<struct<start: long, length: long, ids_crc32: long>>",
                   rows=max(1, at_once >> 11))
    return cut.select(id_col, F.posexplode("pieces").alias("piece", "p")).select(id_col, "piece", "p.*")


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: list[list[int]], room: list[tuple[int, int]], capacity: int) -> None:
    """Put ``items``, in their order, each into the fullest bin that takes it; ``room`` is sorted (free, bin)."""
    for item in items.tolist():
        need = int(lengths[item])
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if free > need:
            insort(room, (free - need, b))


def filling(lengths: np.ndarray, bins: list[list[int]]) -> np.ndarray:
    """Tokens in each of some bins, none of which is empty."""
    if not bins:
        return np.empty(0, np.int64)
    sizes = np.fromiter(map(len, bins), np.int64, len(bins))
    items = np.fromiter(chain.from_iterable(bins), np.int64, int(sizes.sum()))
    return np.add.reduceat(lengths[items], np.cumsum(sizes) - sizes)


class Packing:
    """Bin of every item, with the filling of every bin."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.bins = [b for b in bins if b]
        self.fill = filling(lengths, self.bins)
        # Few bins first; among equals the packing with fuller full bins (and so one emptier rest).
        self.fitness = -len(self.bins) + float(np.mean((self.fill / capacity) ** 2)) if len(self.bins) else 0.0

    def genes(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for i, b in enumerate(self.bins):
            out[b] = i
        return out


def from_genes(lengths: np.ndarray, genes: np.ndarray, capacity: int) -> Packing:
    order = np.argsort(genes, kind="stable")
    cuts = np.flatnonzero(np.diff(genes[order])) + 1
    return Packing(lengths, [b.tolist() for b in np.split(order, cuts)], capacity)


def replace(lengths: np.ndarray, bins: list[list[int]], loose: list[int], capacity: int, rng: np.random.Generator) -> list[int]:
    """Swap one or two items of a bin for one or two loose ones that fill it better; returns what is loose then.

    Of all swaps of a bin the one that leaves least room is made. Few large items come into the bins and
    small ones, which are easier to place, become loose.
    """
    if len(loose) < 2:
        return loose
    order = sorted(loose, key=lambda i: int(lengths[i]))
    sizes = lengths[order]
    for b in rng.permutation(len(bins)).tolist():
        members = sorted(bins[b], key=lambda i: -int(lengths[i]))
        slack = capacity - int(lengths[members].sum())
        if not slack:
            continue
        some = members[:SWAPPED]
        best, swap = 0, None
        for out in chain(([i] for i in some), combinations(some, 2)):
            old = int(lengths[list(out)].sum())
            room = old + slack
            one = int(np.searchsorted(sizes, room, "right")) - 1
            if one < 0:
                continue
            if int(sizes[one]) - old > best:
                best, swap = int(sizes[one]) - old, (out, (one,))
            partner = np.searchsorted(sizes, room - sizes[:one + 1], "right") - 1
            partner = np.minimum(partner, np.arange(one + 1) - 1)  # the smaller of both
            fits = partner >= 0
            both = np.where(fits, sizes[:one + 1] + sizes[partner], 0)
            top = int(both.argmax())
            if int(both[top]) - old > best:
                best, swap = int(both[top]) - old, (out, (top, int(partner[top])))
            if best == slack:
                break
        if swap:
            out, chosen = swap
            bins[b] = [i for i in bins[b] if i not in out] + [order[c] for c in chosen]
            order = sorted([i for c, i in enumerate(order) if c not in chosen] + list(out), key=lambda i: int(lengths[i]))
            sizes = lengths[order]
            if not order:
                break
    return order


def crossover(lengths: np.ndarray, one: Packing, other: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject a random share of ``other``'s fullest bins into ``one`` and best-fit what is displaced."""
    take = max(1, int(len(other.bins) * rng.uniform(0.05, 0.5)))
    keys = other.fill + rng.integers(0, max(1, capacity // 64), len(other.fill))
    injected = [other.bins[i] for i in np.argsort(-keys, kind="stable")[:take]]
    inside = np.zeros(len(lengths), bool)
    inside[np.concatenate([np.array(b) for b in injected])] = True
    owner = one.genes(len(lengths))
    touched = np.zeros(len(one.bins), bool)
    touched[owner[inside]] = True
    # A bin left as it is must be worth keeping; a few poor ones are dissolved too.
    poor = (one.fill < capacity * GOOD) & ~touched
    touched |= poor & (rng.random(len(poor)) < 0.8)
    bins = [list(b) for b in injected] + [list(b) for i, b in enumerate(one.bins) if not touched[i]]
    displaced = np.array(replace(lengths, bins, np.flatnonzero(touched[owner] & ~inside).tolist(), capacity, rng), np.int64)
    fill = filling(lengths, bins)
    room = sorted((capacity - int(f), i) for i, f in enumerate(fill) if f < capacity)
    best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], bins, room, capacity)
    return Packing(lengths, bins, capacity)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Bins that the tokens need at least."""
    return -(-int(lengths.sum()) // capacity)


def decreasing(lengths: np.ndarray, capacity: int) -> Packing:
    """Best-fit decreasing."""
    bins: list[list[int]] = []
    best_fit(lengths, np.argsort(-lengths, kind="stable"), bins, [], capacity)
    return Packing(lengths, bins, capacity)


def poor_bins(packing: Packing, capacity: int) -> np.ndarray:
    """Whether each bin is searched: the poorly filled ones, and the next ones up to CORE items; none at the bound."""
    searched = np.zeros(len(packing.bins), bool)
    if len(packing.bins) > -(-int(packing.fill.sum()) // capacity):
        order = np.argsort(packing.fill, kind="stable")
        sizes = np.fromiter((len(packing.bins[i]) for i in order), np.int64, len(order))
        searched[order] = (packing.fill[order] < GOOD * capacity) | (np.cumsum(sizes) - sizes < CORE)
    return searched


def first_generation(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[Packing]:
    """Best-fit decreasing, and best-fit of blurred orders for the rest of the population."""
    out = [decreasing(lengths, capacity)]
    for _ in range(1, size):
        bins: list[list[int]] = []
        best_fit(lengths, np.argsort(-lengths * rng.uniform(0.8, 1.2, len(lengths)), kind="stable"), bins, [], capacity)
        out.append(Packing(lengths, bins, capacity))
    return out


def evolve(
    lengths: np.ndarray, population: list[Packing], capacity: int, generations: int, rng: np.random.Generator,
) -> tuple[list[Packing], int]:
    """The population after steady-state generations, and its crossovers; stops where the bins are as few as the tokens allow."""
    least, size, crossovers = least_bins(lengths, capacity), len(population), 0
    population = sorted(population, key=lambda p: -p.fitness)
    for _ in range(generations):
        if len(population) < 2 or len(population[0].bins) <= least:
            break
        for _ in range(size // 2):
            a, b = rng.choice(len(population), 2, replace=False)
            population.append(crossover(lengths, population[min(a, b)], population[max(a, b)], capacity, rng))
            crossovers += 1
        population = sorted(population, key=lambda p: -p.fitness)[:size]
    return population, crossovers


def search(
    lengths: np.ndarray, elites: list[np.ndarray] | None, capacity: int, generations: int, size: int, rng: np.random.Generator,
) -> tuple[list[np.ndarray], float, int]:
    """One epoch of one island: bins of all items per individual, best first, its fitness, and the crossovers.

    Well-filled bins of best-fit decreasing stay as they are; every epoch and island finds the same ones.
    """
    start = decreasing(lengths, capacity)
    searched = poor_bins(start, capacity)
    if not searched.any():
        return [start.genes(len(lengths))], start.fitness, 0
    owner = start.genes(len(lengths))
    core = np.flatnonzero(searched[owner])
    fixed = (np.cumsum(~searched) - 1)[owner].astype(np.int32)
    some = lengths[core]
    if elites is None:
        population = first_generation(some, capacity, size, rng)
    else:
        population = [from_genes(some, g[core], capacity) for g in elites]
    population, crossovers = evolve(some, population, capacity, generations, rng)
    out = []
    for p in population:
        genes = fixed.copy()
        genes[core] = p.genes(len(some)) + int((~searched).sum())
        out.append(genes)
    return out, population[0].fitness, crossovers


def _pack_shards(
    pieces: DataFrame, capacity: int, islands: int, epochs: int, generations: int, population: int,
) -> DataFrame:
    """(shard, rid, length) to (shard, rid, bin, fill) by islands that exchange their elites."""
    shards = pieces.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("rid", "length"))).alias("items"))
    items = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                          F.col("items.rid").alias("rids"), F.col("items.length").alias("lengths"))
    fields = "shard long, island int, rids array<long>, lengths array<long>, elites array<binary>, fitness double"

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    lengths = np.asarray(row.lengths, np.int64)
                    rng = np.random.default_rng([int(row.shard) & 0x7FFFFFFF, int(row.island), number])
                    elites = [np.frombuffer(g, np.int32) for g in row.elites] if number else None
                    have, fitness, _ = search(lengths, elites, capacity, generations, population, rng)
                    yield pd.DataFrame({
                        "shard": [row.shard], "island": [row.island], "rids": [row.rids], "lengths": [row.lengths],
                        "elites": [[g.tobytes() for g in have]], "fitness": [fitness]})
        return run

    state = items.repartition(F.col("shard"), F.col("island")).mapInPandas(epoch(0), fields)
    for number in range(1, epochs):
        state = cut_lineage(state, "packing")
        sent = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                            F.slice("elites", 1, 1).alias("guest"))
        state = state.join(sent, ["shard", "island"]).withColumn("elites", F.concat("elites", "guest"))
        state = state.select("shard", "island", "rids", "lengths", "elites").mapInPandas(epoch(number), fields)

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                genes = np.frombuffer(row.gene, np.int32)
                fill = np.bincount(genes, np.asarray(row.lengths, np.float64)).astype(np.int64)
                yield pd.DataFrame({"shard": row.shard, "rid": row.rids, "bin": genes.astype(np.int64), "fill": fill[genes],
                                    "length": row.lengths})

    best = cut_lineage(state, "packing")
    winner = best.groupBy("shard").agg(F.max_by("island", "fitness").alias("island"))
    return (
        best.join(winner, ["shard", "island"]).select("shard", "rids", "lengths", F.col("elites")[0].alias("gene"))
        .mapInPandas(unfold, "shard long, rid long, bin long, fill long, length long")
    )


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS,
    generations: int = GENERATIONS, population: int = POPULATION,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Every row is placed once; sequences hold ``capacity`` at most and have no gaps. Repeated rows are
    rows of their own. An empty table gives no rows. A full-length piece is a sequence by itself.
    Shards hold ``shard`` pieces on average however the input is skewed, because rows are dealt by number.
    """
    numbered = cut_lineage(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")

    def deal(rows: DataFrame, salt: int) -> DataFrame:
        count = -(-rows.count() // shard) or 1
        return rows.select("rid", "length", F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(count)).alias("shard"))

    full = numbered.where(F.col("length") == capacity).select("rid", F.col("rid").alias("key"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("shard"))
    loose = numbered.where(F.col("length") < capacity)
    rounds = (islands, epochs, generations, population)
    first = cut_lineage(_pack_shards(deal(loose, 1), capacity, *rounds), "packed")
    good = F.col("fill") >= int(GOOD * capacity)
    again = _pack_shards(deal(first.where(~good), 2), capacity, *rounds)
    placed = full.unionByName(
        first.where(good).select("rid", F.col("bin").alias("key"), F.lit(1).alias("round"), "shard")
    ).unionByName(again.select("rid", F.col("bin").alias("key"), F.lit(2).alias("round"), "shard"))
    # A sequence holds at most capacity pieces, so its rows fit one window group.
    bins = (
        placed.join(numbered.select("rid", "length"), "rid")
        .groupBy("round", "shard", "key").agg(F.sort_array(F.collect_list(F.struct("rid", "length"))).alias("members"))
        .withColumn("sequence_id", F.when(F.col("round") == 0, F.col("key") * 4)
                    .otherwise((F.col("shard") * (1 << 24) + F.col("key")) * 4 + F.col("round")))
        .select("sequence_id", F.posexplode("members").alias("i", "m"), "members")
        .select(F.col("m.rid").alias("rid"), "sequence_id", F.aggregate(
            F.slice("members", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("offset"))
    )
    return numbered.join(bins, "rid").drop("rid")


def op6_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens in as few sequences as the search finds."""
    return pack(cut_pieces(table(spark, sf_dir, "documents")))
