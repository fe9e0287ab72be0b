"""Words, hashes and table access shared by the training-data operators.

A word is a run of bytes other than space and \\x09-\\x0D, which is what ``bytes.split()`` yields on UTF-8.
Word and n-gram hashes are computed for whole texts with numpy; every hash is 64 bits wide.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from signalpact.session import cut_lineage

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BLOCK = 1 << 20
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_GRAM = np.uint64(0xA0761D6478BD642F)
_GRAM_INV = np.uint64(pow(int(_GRAM), -1, 1 << 64))
#: A-Z to a-z, other bytes unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call unless very long."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(4096, 1 << (max(n, 1) - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 21:
            _powers[int(base)] = have
    return have[:n]


def _hash_block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(_IN_WORD[b])
    if not len(at):
        return np.empty(0, np.uint64), at, at
    first = np.empty(len(at), dtype=bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    lengths = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    hashed = _BYTE[b[at]] * powers(_BASE, int(lengths.max()))[place]
    begin = at[starts]
    return mix(np.add.reduceat(hashed, starts) + lengths.astype(np.uint64) * _STEP), begin, begin + lengths


def word_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, the first byte and the byte after the last of every word of a whole text, in order."""
    parts, i, n = [], 0, len(data)
    while i < n:
        j = min(i + _BLOCK, n)
        if j < n:
            found = _SPACE.search(data, j)
            j = found.start() if found else n
        hashes, starts, ends = _hash_block(np.frombuffer(data, np.uint8, j - i, i))
        parts.append((hashes, starts + i, ends + i))
        i = j
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word of a whole text, in order."""
    return word_table(data)[0]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for j, p in enumerate(powers(_GRAM, k)[1:], 1):
        total += words[j:j + n] * p
    return mix(total)


def narrow(pattern: str) -> str:
    """A pattern of the regex module for the faster re module, equal on texts without characters from U+0530 on, and on
    such texts lower-cased (a few of their letters lie higher then): classes are listed."""
    classes = re.compile(r"\\[pP]\{\^?\w+\}|\\[sSdDwW]|\\.|\[\^?|\]", re.DOTALL)
    low, inside = sorted({c for i in range(0x530) for c in (chr(i), *chr(i).lower())}), False

    def told(found: re.Match) -> str:
        nonlocal inside
        part = found[0]
        if part[0] != "\\":
            inside = part != "]"
            return part
        if part[1] not in "pPsSdDwW":
            return part
        held = "".join(f"\\u{ord(c):04x}" for c in low if regex.fullmatch(part, c))
        return held if inside else f"[{held}]"

    return classes.sub(told, pattern)


class Spans:
    """Hashes of arbitrary word ranges of one text, from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.back = powers(_GRAM_INV, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(_GRAM, n), out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * _STEP)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def slices(texts: list, most: int = 1 << 22) -> Iterator[slice]:
    """Consecutive ranges of rows with about ``most`` characters each, one row at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += 0 if t is None else len(t)
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` itself if it only reads Parquet files, else its written copy: so that :func:`numbered` can tell its rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().head()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        relation = plan.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
            return df
    return cut_lineage(df, purpose)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns: the ``wanted`` ones, led by underscores until no column of ``df`` has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name as an expression takes it, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


#: Rows of one file that get numbers of their own.
_FILE_ROWS = 1 << 40


def numbered(df: DataFrame, purpose: str, name: str = "rid") -> DataFrame:
    """``df`` (its written copy if it does more than read Parquet files) with a bigint ``name``, unique per row.

    The number is that of the row's file, by path, and of the row in its file. So it is the same in every
    later job, however the files are split there: splits follow the cores that are present.
    """
    df = stored(df, purpose)
    path, at, file, meta = free_names(df, "_path", "_at", "_file", "_meta")
    source = df.select("*", F.struct(df.metadataColumn("_metadata")["file_path"].alias("path"), df.metadataColumn("_metadata")["row_index"].alias("at")).alias(meta))
    placed = source.select(*map(quoted, df.columns), F.col(meta)["path"].alias(path), F.col(meta)["at"].alias(at))
    seen = sorted(r[0] for r in placed.select(path).distinct().collect())  # the driver lists these files anyway
    files = df.sparkSession.createDataFrame(list(enumerate(seen)), f"{file} long, {path} string")
    return placed.join(F.broadcast(files), path).select(*map(quoted, df.columns), (F.col(file) * _FILE_ROWS + F.col(at)).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Spark send texts to Python in batches of ``most`` bytes instead of 64 MB, for the rest of the session.

    A batch is held by the executor, by the Arrow writer and by the Python worker at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(key) if c.isdigit())) != most:
        spark.conf.set(key, str(most))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving a task's memory back when it ends: Python workers stay for later tasks of other operators."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim:
                trim(0)

    return tidied


def per_text(
    df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list], dict]], added: str, rows: int = 512,
) -> DataFrame:
    """One output row per input row: the columns ``keep`` untouched plus what a function makes of whole texts.

    ``make`` runs once per task and returns a function from some texts to its columns (``added``, a DDL).
    ``text`` may be one of ``keep``.
    Columns pass through Arrow, so nulls and wide integers in ``keep`` survive.
    """
    bound_batches(df.sparkSession)
    fields = StructType.fromDDL(added).fields
    schema = StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, arrow = make(), to_arrow_schema(StructType(fields))
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                out = work(part.column(at).to_pylist())
                columns = [part.column(k) for k in range(len(keep))]
                columns += [pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    at = keep.index(text) if text in keep else len(keep)
    read = [*keep, *([] if text in keep else [text])]  # by place: names may hold dots, which mapInArrow can't resolve
    return df.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(read))).mapInArrow(tidy(run), schema)
