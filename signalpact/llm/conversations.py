"""Repair of conversation structure: the cheapest edits that make roles alternate, the least audit among them.

Rows are sorted and cut into chunks of bounded size. A backward cost DP gives every (row, state) node what
the rest costs, which marks the optimal arcs (edits). Arcs are then ranked among those of the same row by
the least audits of 1, 2, 4, ... letters that start with them, while pointers to the arc behind those
letters double; the least path is read off the doubled pointers. A conversation over several chunks is
tied together by 4 x 4 matrices per chunk, first of costs, then of the states that least paths lead to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from signalpact.llm.text import bound_batches, table, tidy
from signalpact.session import cut_lineage

#: Distinct rows, and bytes, of a conversation that are repaired at once.
ENTRIES, BYTES = 4096, 4 << 20
#: Matrices that are multiplied in one group.
FAN = 1024
#: Rows that are ranked side by side.
SIDE = 1 << 14
INF = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
LETTERS = "DIKR"
ROLES = {2: "user", 3: "assistant"}
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A rerole or an insert leads on to the next speaker.
_NEXT = np.array([2, 2, 3, 2])
# Where a kept row leads, by its initial (system, user, assistant, other) and the state; 4: nowhere.
_KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
#: What is left to pay at the end of a conversation, by state.
_END = np.array([0, 2 * INSERT, INSERT, 0])
# Fault of a row, two bits of its code; the initial is the two above.
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of damaged rows; nulls count as one space, but a turn or id stays null.

    By ``crc32("conv_id:turn") % 20``: 0 drops the row, 1 empties the text, 2 removes ``.!?`` from it, 3 doubles
    the row, 4 sets the role to user.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20).cast("int")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), by.alias("by")).select(
        "conv_id", "turn", F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("by") == 0, 0).when(F.col("by") == 3, 2).otherwise(1).alias("copies"),
    ).where("copies > 0")


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and their code: initial * 4 + fault of the first copy.

    A text seen earlier is marked by a row of its own (conversation, first turn, hash), so that neither a
    frequent text nor a long conversation is gathered anywhere.
    """
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same")
    hashed = rows.select("*", same)
    first = hashed.groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    marks = first.select(
        "conv_id", F.col("at.turn").alias("turn"), "same", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.lit(0).alias("copies"), F.lit(True).alias("first"))
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    return (
        hashed.select("conv_id", "turn", "same", "role", "text", "copies", F.lit(False).alias("first")).unionByName(marks)
        .groupBy("conv_id", "turn", "same")
        .agg(F.max("role").alias("role"), F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("first").alias("first"))
        .select("conv_id", "turn", "role", "text", "copies", (
            F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)
            + F.when(body == "", BLANK).when(~F.col("first"), DUPLICATE).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
        ).cast("tinyint").alias("code"))
    )


def _chunks(coded: DataFrame) -> DataFrame:
    """The written chunks: consecutive rows of one conversation, numbered by (part, seq).

    ``whole`` says that a chunk is certainly its conversation: it lies inside its partition.
    """
    bound_batches(coded.sparkSession)
    kind = coded.schema["conv_id"].dataType.simpleString()
    ordered = coded.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    ddl = (f"conv_id {kind}, part long, seq long, whole boolean, turns array<long>, roles array<string>, texts array<string>, "
           "copies array<long>, codes array<tinyint>")
    arrow = to_arrow_schema(coded.sparkSession.createDataFrame([], ddl).schema)
    entries, most = ENTRIES, BYTES

    def cut(batch: pa.RecordBatch, starts: list[int], whole: list[bool], seq: int) -> pa.RecordBatch:
        part, ends = TaskContext.get().partitionId(), [*starts[1:], batch.num_rows]
        offsets = pa.array([*starts, ends[-1]], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(k)) for k in range(1, 6)]
        columns = [batch.column(0).take(pa.array(starts)), pa.array([part] * len(starts)), pa.array(range(seq, seq + len(starts))), pa.array(whole), *lists]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq, touched = None, 0, True  # touched: the held rows' conversation may go back before them
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            ids = batch.column(0).to_pylist()
            new = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            starts, whole = [], []
            for a, b in zip(new, [*new[1:], len(ids)], strict=True):
                pieces = list(range(a, b, entries))
                starts += pieces
                whole += [len(pieces) == 1 and not (touched and a == 0)] * len(pieces)
            last = starts[-1]
            held = batch.slice(last)
            full = held.num_rows >= entries or held.nbytes >= most
            if full:
                whole[-1] = False
                yield cut(batch, starts, whole, seq)
                seq, held, touched = seq + len(starts), None, True
            else:
                touched = not whole[-1]
                if starts[:-1]:
                    yield cut(batch.slice(0, last), starts[:-1], whole[:-1], seq)
                    seq += len(starts) - 1
        if held is not None:
            yield cut(held, [0], [False], seq)

    return cut_lineage(ordered.select("conv_id", "turn", "role", "text", "copies", "code").mapInArrow(tidy(run), ddl), "conversations")


class Rows:
    """Rows of some chunks side by side: further copies of a row are one more row, which must go."""

    def __init__(self, codes: list[np.ndarray], copies: list[np.ndarray]):
        self.entry, parts, times = [], [], []
        for code, n in zip(codes, copies, strict=True):
            code, n = np.asarray(code, np.int64), np.asarray(n, np.int64)
            split = ((code & 3) < DUPLICATE) & (n > 1)
            at = np.repeat(np.arange(len(code)), 1 + split)
            again = np.zeros(len(at), bool)
            again[1:] = at[1:] == at[:-1]
            self.entry.append(at)
            parts.append(np.where(again, code[at] & ~3 | DUPLICATE, code[at]))
            times.append(np.where(again, n[at] - 1, np.where(split[at], 1, n[at])))
        self.length = np.array([len(x) for x in parts])
        self.width = int(self.length.max(initial=0))
        self.code, self.times = (np.zeros((len(parts), self.width), np.int64) for _ in range(2))
        for i, (code, n) in enumerate(zip(parts, times, strict=True)):
            self.code[i, :len(code)], self.times[i, :len(code)] = code, n

    def edits(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows at place ``p``: costs of deleting, keeping and reroling, and the states that keeping leads to."""
        initial, fault = self.code[:, p] >> 2, self.code[:, p] & 3
        extra = np.where(fault >= DUPLICATE, INF, np.where(fault == TRUNCATED, CUT_OFF, 0))
        return DELETE * self.times[:, p], extra, extra + REROLE, _KEEP[initial]

    def remaining(self, right: np.ndarray) -> np.ndarray:
        """Least cost from every (place, state) on, given those behind the last place."""
        n, every = len(self.length), np.arange(len(self.length))
        left = np.full((n, self.width + 1, 5), INF, np.int64)  # state 4: nowhere
        left[every, self.length, :4] = right
        for p in range(self.width - 1, -1, -1):
            ahead = left[:, p + 1]
            delete, keep, rerole, to = self.edits(p)
            best = np.minimum(delete[:, None] + ahead[:, :4], keep[:, None] + np.take_along_axis(ahead, to, 1))
            best = np.minimum(best, rerole[:, None] + ahead[:, _NEXT])
            user, assistant = np.minimum(best[:, 2], INSERT + best[:, 3]), np.minimum(best[:, 3], INSERT + best[:, 2])
            best[:, 2], best[:, 3] = user, assistant
            best[:, :2] = np.minimum(best[:, :2], INSERT + user[:, None])
            here = p < self.length
            left[here, p, :4] = np.minimum(best[here], INF)
        return left

    def least(self, right: np.ndarray, last: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk the arcs of the least optimal path that enters in a state, and the state it leaves in.

        An arc is (place * 4 + state) * 4 + letter; behind the last one comes -1.
        """
        left, n, places = self.remaining(right), len(self.length), self.width + 1
        every = np.arange(n)[:, None] * places
        head = np.zeros((n, places, 4, 4), np.int64)
        cost = np.full((n, places, 4, 4), INF, np.int64)
        state = np.arange(4)
        for p in range(places):
            inserts = (p < self.length) | last & (p == self.length)
            head[:, p, :, 1], cost[:, p, :, 1] = (every + p) * 4 + _NEXT, np.where(inserts, INSERT, INF)[:, None]
            if p < self.width:
                delete, keep, rerole, to = self.edits(p)
                ahead = (every + p + 1) * 4
                for letter, target, price in ((0, state, delete), (2, to, keep), (3, _NEXT, rerole)):
                    there = (p < self.length)[:, None] & (target < 4)
                    head[:, p, :, letter] = ahead + np.where(target < 4, target, 0)
                    cost[:, p, :, letter] = np.where(there, price[:, None], INF)
        worth = left[:, :, :4].reshape(-1)
        optimal = (cost < INF) & (left[:, :, :4, None] == cost + worth[head])
        arcs = optimal.size
        # Rank 0 is the end of an audit, which is a node of its own behind all arcs.
        rank = np.append(np.where(optimal, np.arange(1, 5), 99).reshape(-1), 0)
        of_node = rank[:-1].reshape(-1, 4)
        lead = np.where(of_node.min(1) < 99, np.arange(len(of_node)) * 4 + of_node.argmin(1), arcs)
        pointer = np.append(np.where(rank[:-1] < 99, lead[head.reshape(-1)], arcs), arcs)
        pointers = []
        for _ in range(max(1, int(2 * self.width + 4).bit_length())):
            pointers.append(pointer)
            key = (rank * 100 + rank[pointer])[:-1].reshape(-1, 16)  # arcs of one row: equal audits so far lead to one row
            order = key.argsort(1)
            ordered = np.take_along_axis(key, order, 1)
            dense = np.ones_like(key)
            dense[:, 1:] += np.cumsum(ordered[:, 1:] != ordered[:, :-1], 1)
            ranked = np.empty_like(key)
            np.put_along_axis(ranked, order, dense, 1)
            rank = np.append(np.where(optimal.reshape(-1), ranked.reshape(-1), 99), 0)
            pointer = pointer[pointer]
        start = np.arange(n) * places * 4 + entry
        of_node = rank[:-1].reshape(-1, 4)[start]
        path = np.where(of_node.min(1) < 99, start * 4 + of_node.argmin(1), arcs)[:, None]
        for pointer in reversed(pointers):
            path = np.stack([path, pointer[path]], 2).reshape(n, -1)
        there = path < arcs
        final = np.take_along_axis(path, np.maximum(there.sum(1) - 1, 0)[:, None], 1)[:, 0]
        out = np.where(there[:, 0], np.append(head.reshape(-1) % 4, 0)[final], entry)
        return np.where(there, path % (places * 16), -1), out


def _batched(lengths: list[int], times: int = 1) -> Iterator[list[int]]:
    """Chunks of similar length, so many that SIDE rows are looked at together."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    some: list[int] = []
    for i in order:
        if some and (len(some) + 1) * times * (lengths[i] + 1) > SIDE:
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def _light(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return tuple([np.array(x, np.int64) for x in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in ("codes", "copies"))


def _matrices(df: DataFrame, exits: bool) -> DataFrame:
    """(key, idx, m) per chunk: what crossing it costs, or (``exits``) which state a least path leads to (0, else INF)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, copies = _light(batch)
            found: list = [None] * len(codes)
            right = batch.column(batch.schema.get_field_index("right")).to_pylist() if exits else None
            last = batch.column(batch.schema.get_field_index("last")).to_pylist() if exits else None
            for some in _batched([2 * len(c) for c in codes], 4):
                four = [i for i in some for _ in range(4)]
                rows, state = Rows([codes[i] for i in four], [copies[i] for i in four]), np.tile(np.arange(4), len(some))
                if exits:
                    _, out = rows.least(np.array([right[i] for i in four]), np.array([last[i] for i in four]), state)
                    m = np.where(out[:, None] == np.arange(4), 0, INF).reshape(-1, 16)
                else:
                    ahead = np.where(state[:, None] == np.arange(4), 0, INF)
                    m = rows.remaining(ahead)[:, 0, :4].reshape(-1, 4, 4).transpose(0, 2, 1).reshape(-1, 16)
                for i, x in zip(some, m.tolist(), strict=True):
                    found[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["key", "idx", "m"])

    columns = ["key", "idx", "codes", "copies", *(["right", "last"] if exits else [])]
    return df.select(*columns).mapInArrow(tidy(run), "key string, idx long, m array<long>")


def _prefixes(steps: DataFrame, start: list[int]) -> DataFrame:
    """(key, idx, v): ``start`` times the matrices of smaller idx, in min-plus arithmetic.

    Groups of FAN matrices become one, until a key has one group; then the vectors come back down.
    """

    def times(v: np.ndarray, m: list[int]) -> np.ndarray:
        return np.minimum((v[..., :, None] + np.array(m).reshape(4, 4)).min(-2), INF)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        v, out = np.array(group["v"].iloc[0]), []
        for m in group["m"]:
            out.append(v.tolist())
            v = times(v, m)
        return pd.DataFrame({"key": group["key"], "idx": group["idx"], "v": out})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        total = np.where(np.eye(4, dtype=bool), 0, INF)
        for m in group["m"]:
            total = times(total, m)
        return pd.DataFrame({"key": [group["key"].iloc[0]], "idx": [group["idx"].iloc[0] // fan], "m": [total.ravel().tolist()]})

    fan = FAN
    upper = F.floor(F.col("idx") / fan).cast("long")
    vector = F.array(*[F.lit(int(x)).cast("long") for x in start])
    if steps.where(F.col("idx") >= fan).limit(1).count():
        up = cut_lineage(steps.groupBy("key", upper.alias("above")).applyInPandas(fold, "key string, idx long, m array<long>"), "folded")
        above = _prefixes(up, start).withColumnRenamed("idx", "above")
        placed = steps.withColumn("above", upper).join(above, ["key", "above"])
    else:
        placed = steps.withColumn("above", upper).withColumn("v", vector)
    walked = placed.groupBy("key", "above").applyInPandas(lambda g: walk(g[["key", "idx", "m", "v"]]), "key string, idx long, v array<long>")
    return cut_lineage(walked, "prefixes")


def _tied(chunks: DataFrame) -> DataFrame:
    """(part, seq, idx, last, right, entry, clash) of chunks that may share a conversation with others.

    ``right`` is what is left to pay behind a chunk, ``entry`` the state in which the least path enters it,
    ``clash`` whether its first row doesn't follow from the row before the chunk.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    light = chunks.select(name.alias("key"), "part", "seq", "codes", "copies")
    runs = light.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least"))
    parts = Window.partitionBy("key").orderBy("part")  # a row per partition that holds the conversation
    before = runs.select(
        "key", "part", "least", F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("key")).alias("total"))
    placed = light.join(before, ["key", "part"]).select(
        "key", (F.col("before") + F.col("seq") - F.col("least")).alias("idx"), "total", "part", "seq", "codes", "copies")
    placed = cut_lineage(placed, "placed")
    turned = F.expr("transform(sequence(0, 15), i -> m[(i % 4) * 4 + cast(i / 4 AS int)])")
    back = _matrices(placed, False).join(placed.select("key", "idx", "total"), ["key", "idx"]).select(
        "key", (F.col("total") - 1 - F.col("idx")).alias("idx"), turned.alias("m"))
    rights = _prefixes(back, _END.tolist()).withColumnsRenamed({"idx": "from_end", "v": "right"})
    known = placed.withColumn("from_end", F.col("total") - 1 - F.col("idx")).join(rights, ["key", "from_end"]).withColumn("last", F.col("from_end") == 0)
    known = cut_lineage(known, "rights")
    entries = _prefixes(_matrices(known, True), [0, INF, INF, INF]).select("key", "idx", (F.array_position("v", 0) - 1).cast("int").alias("entry"))
    initial = lambda at: F.floor(F.element_at("codes", at) / 4).cast("int")
    ends = placed.select("key", (F.col("idx") + 1).alias("idx"), initial(-1).alias("ahead"))
    follows = " OR ".join(f"ahead = {a} AND own = {b}" for a, b in zip(*map(np.ndarray.tolist, np.nonzero(_LEGAL)), strict=True))
    return known.join(entries, ["key", "idx"]).withColumn("own", initial(1)).join(ends, ["key", "idx"], "left").select(
        "part", "seq", "idx", "last", "right", "entry", F.expr(f"CASE WHEN ahead IS NOT NULL AND NOT ({follows}) THEN 1L ELSE 0L END").alias("clash"))


def repair(conversations: DataFrame) -> DataFrame:
    """Repairs ``conversations`` (conv_id, turn, role, text, copies); a row per chunk of a conversation, in the order of idx.

    Columns: conv_id, ``idx``, ``alone`` (the chunk is the conversation), ``turns`` (distinct known ones), blank,
    duplicate, truncated, illegal (longs, counted before the repair; illegal includes the step into the
    chunk), cost, ``audit`` and ``rows`` (role and text after the repair).

    Rows of a conversation are taken by turn (nulls first), then role and text, which only matters where a turn
    repeats. A role or text must not be null; a null conv_id is a conversation as any other. An empty table
    gives no rows; other columns are ignored. Rows of equal turn, role and text are counted before they are
    sorted, so repeated rows cost one row; a conversation of any length is spread over chunks and partitions.
    """
    chunks = _chunks(_coded(conversations))
    edge = chunks.where("NOT whole")
    columns = ["conv_id", "turns", "roles", "texts", "copies", "codes"]
    whole = chunks.where("whole").select(
        *columns, F.lit(0).cast("long").alias("idx"), F.lit(True).alias("last"), F.array(*[F.lit(int(x)).cast("long") for x in _END]).alias("right"),
        F.lit(0).alias("entry"), F.lit(0).cast("long").alias("clash"))
    tied = edge.join(_tied(edge), ["part", "seq"]).select(*columns, "idx", "last", "right", "entry", "clash")
    kind = chunks.schema["conv_id"].dataType.simpleString()
    ddl = (f"conv_id {kind}, idx long, alone boolean, turns array<long>, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, rows array<struct<role:string,text:string>>")
    arrow = to_arrow_schema(chunks.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("roles", "texts", "turns", "idx", "last", "right", "entry", "clash")}
            codes, copies = _light(batch)
            out: list = [None] * len(codes)
            for some in _batched([2 * len(c) for c in codes]):
                rows = Rows([codes[i] for i in some], [copies[i] for i in some])
                last = np.array([told["last"][i] for i in some])
                paths, _ = rows.least(np.array([told["right"][i] for i in some]), last, np.array([told["entry"][i] for i in some]))
                for k, i in enumerate(some):
                    out[i] = _told(rows, k, paths[k], told["roles"][i], told["texts"][i]) + (told["idx"][i] == 0 and told["last"][i],)
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            blank, duplicate, truncated, illegal, cost, audit, repaired, alone = columns
            values = {
                "conv_id": batch.column(0), "idx": told["idx"], "alone": alone, "turns": [sorted({t for t in x if t is not None}) for x in told["turns"]],
                "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": [a + b for a, b in zip(illegal, told["clash"], strict=True)],
                "cost": cost, "audit": audit, "rows": repaired}
            yield pa.RecordBatch.from_arrays(
                [values[f.name] if isinstance(values[f.name], pa.Array) else pa.array(values[f.name], f.type) for f in arrow], schema=arrow)

    return whole.unionByName(tied).mapInArrow(tidy(run), ddl)


def _told(rows: Rows, k: int, path: np.ndarray, roles: list[str], texts: list[str]) -> tuple:
    """Counts, cost, audit and repaired rows of the k-th chunk."""
    n = rows.length[k]
    code, times, entry = rows.code[k, :n], rows.times[k, :n], rows.entry[k]
    initial, fault = code >> 2, code & 3
    counts = [int(times[fault == f].sum()) for f in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum() + (times - 1).sum())
    cost, audit, repaired = 0, [], []
    for arc in path[path >= 0].tolist():
        p, state, letter = arc // 16, arc // 4 % 4, arc % 4
        if letter == 0:
            audit.append("D" * int(times[p]))
            cost += DELETE * int(times[p])
            continue
        audit.append(LETTERS[letter])
        cost += (INSERT, 0, REROLE)[letter - 1] + (CUT_OFF if letter > 1 and fault[p] == TRUNCATED else 0)
        role = roles[entry[p]] if letter == 2 else ROLES[int(_NEXT[state])]
        repaired.append({"role": role, "text": "" if letter == 1 else texts[entry[p]]})
    return (*counts, illegal, cost, "".join(audit), repaired)


def _gaps(least: Column, most: Column, distinct: Column) -> Column:
    return F.coalesce(F.try_subtract(F.try_subtract(most, least), distinct - 1), F.lit(0).cast("long"))


def report(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, the counts, cost, audit and the digest of the repaired rows.

    The digest is SHA-256 of ``role:text`` lines; that of a conversation in several chunks has to be
    computed from end to end, chunk by chunk as they stream by. ``gaps`` is 0 without
    known turns or where it exceeds a bigint; an audit must fit into one string.
    """
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")
    body = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    distinct = F.size("turns").cast("long")
    alone = repaired.where("alone").select(
        "conv_id", _gaps(F.array_min("turns"), F.array_max("turns"), distinct).alias("gaps"), *sums, "audit", F.sha2(body, 256).alias("repaired_sha256"))

    parts = repaired.where("NOT alone")
    kind = repaired.schema["conv_id"].dataType.simpleString()
    turns = parts.select("conv_id", F.explode_outer("turns").alias("turn")).groupBy("conv_id").agg(
        _gaps(F.min("turn"), F.max("turn"), F.count_distinct("turn")).alias("gaps"))
    added = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in sums])
    streamed = parts.select("conv_id", "idx", "audit", F.when(F.size("rows") > 0, body).alias("body")).repartition("conv_id").sortWithinPartitions("conv_id", "idx")
    ddl = f"conv_id {kind}, audit string, repaired_sha256 string"
    arrow = to_arrow_schema(repaired.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, own, audit, digest, empty = False, None, [], hashlib.sha256(), True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((own, "".join(audit), digest.hexdigest()), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for conv_id, idx, letters, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if idx == 0:
                    if begun:
                        yield done()
                    begun, own, audit, digest, empty = True, conv_id, [], hashlib.sha256(), True
                audit.append(letters)
                if text is not None:
                    digest.update(("" if empty else "\n").encode() + text.encode())
                    empty = False
        if begun:
            yield done()

    told = streamed.mapInArrow(tidy(run), ddl)
    none = lambda kind: F.lit(None).cast(kind)
    columns = ("gaps", *sums, "audit", "repaired_sha256")
    every = alone
    for frame in (conversations.select("conv_id").distinct(), turns, added, told):
        every = every.unionByName(frame.select("conv_id", *[
            F.col(c) if c in frame.columns else none("string" if c in columns[-2:] else "long").alias(c) for c in columns]))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    return every.groupBy("conv_id").agg(
        zero("gaps"), *[zero(c) for c in sums], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_path_ranked_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the checksum of their turns and repaired."""
    conversations = table(spark, sf_dir, "conversations")
    return report(conversations, cut_lineage(repair(damage(conversations)), "repaired"))
