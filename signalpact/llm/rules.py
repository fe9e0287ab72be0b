"""Quality rules: statistics of whole texts and an isolation forest over them.

A forest isolates points by random splits of rule statistics; short mean paths mark anomalies. One forest sees
the characters, one the repetition, figures and length. They are grown on a bounded sample of all rows, and
their thresholds are calibrated on all labelled rows, the second on what the first leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpact.llm.text import gram_hashes, per_text, table, text_bytes, word_hashes
from signalpact.session import cut_lineage

#: Rows the forest may be grown on, and rows per tree.
SAMPLE, PER_TREE = 8192, 256
TREES = 100
#: Share of the labelled good rows that the threshold may cost.
GOOD_LOSS = 0.01
#: Resolution of the score histogram the threshold is taken from.
BINS = 2000
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_bars", "n_digits", "n_letters",
         "n_stutters")
_SPACES = [32, 9, 10, 11, 12, 13]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_MARKS = [ord(c) for c in "!?"]
#: The window of the repetition rule, in words.
WINDOW = 8


def repeated_words(words: np.ndarray, k: int = WINDOW) -> int:
    """Words covered by ``k``-word windows that occur twice or more in the text, the first one included."""
    grams = gram_hashes(words, k)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_stats(text: str | None) -> tuple:
    """The values of STATS for one whole text; null counts as empty."""
    data = text_bytes(text)
    if not data:
        return (0,) * len(STATS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = word_hashes(data)
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    chars = int(counts[:128].sum() + counts[192:].sum())
    upper = int(counts[65:91].sum())
    return (
        len(words), chars - int(counts[_SPACES].sum()), int(counts[_SYMBOLS].sum()), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), upper, int(counts[_MARKS].sum()), int(counts[ord("|")]),
        int(counts[48:58].sum()), upper + int(counts[97:123].sum()), int((words[1:] == words[:-1]).sum()),
    )


def with_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep..., STATS) of every row, from one pass over the whole texts."""

    def make():
        def work(texts: list) -> dict:
            rows = np.array([text_stats(t) for t in texts], np.int64).reshape(len(texts), len(STATS))
            return {name: rows[:, i] for i, name in enumerate(STATS)}

        return work

    return per_text(docs, keep, text, make, ", ".join(f"{c} long" for c in STATS))


#: Number of ratios(), and which of them each forest sees. Characters come first: many good rows repeat lines, and in
#: one forest they would hide the odd characters of bad ones.
FEATURES = 10
FORESTS = (slice(0, 5), slice(5, 10))


def ratios() -> list[Column]:
    """Features of a row with STATS: every statistic by its share, and the length as a logarithm."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return [
        F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        F.col("n_marks") / words, F.col("n_bars") / words, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words,
        F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_stutters") / words, F.log1p(F.col("n_words").cast("double")),
    ]


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, np.float64)
    big = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: feature, cut, left child (right is the next one) and mean path at a leaf."""

    def __init__(self, points: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(per_tree, len(points))
        self.depth = int(np.ceil(np.log2(max(size, 2))))
        self.feature, self.cut, self.left, self.path, self.roots = [], [], [], [], []
        for _ in range(trees if len(points) else 0):
            self.roots.append(self._grow(points[rng.choice(len(points), size, replace=False)], rng))
        self.norm = max(float(average_path(size)), 1.0)
        self.feature, self.left = np.array(self.feature, np.int64), np.array(self.left, np.int64)
        self.cut, self.path = np.array(self.cut, np.float64), np.array(self.path, np.float64)

    def _node(self) -> int:
        for values, value in ((self.feature, 0), (self.cut, 0.0), (self.left, -1), (self.path, 0.0)):
            values.append(value)
        return len(self.left) - 1

    def _grow(self, points: np.ndarray, rng: np.random.Generator) -> int:
        root = self._node()
        todo = [(root, points, 0)]
        while todo:
            node, here, depth = todo.pop()
            low, high = here.min(axis=0), here.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(here) < 2 or not len(open_):
                self.path[node] = depth + float(average_path(len(here)))
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            left, right = self._node(), self._node()
            self.feature[node], self.cut[node], self.left[node] = f, cut, left
            todo += [(left, here[here[:, f] < cut], depth + 1), (right, here[here[:, f] >= cut], depth + 1)]
        return root

    def score(self, points: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 ** -(mean path / expected path); 0 without trees."""
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for root in self.roots:
            node = np.full(len(points), root)
            for _ in range(self.depth + 1):
                left = self.left[node]
                go = left + (points[rows, self.feature[node]] >= self.cut[node])
                node = np.where(left < 0, node, go)
            total += self.path[node]
        return 2.0 ** -(total / max(len(self.roots), 1) / self.norm) if len(self.roots) else total


def threshold(histogram: list[tuple[int, int, int]], good_loss: float = GOOD_LOSS) -> float:
    """Least score to reject, from (bin, good, bad): most bad rows caught at a bounded loss of good ones.

    Without good rows nothing is rejected by the forest (threshold above 1).
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for at, g, b in histogram:
        good[at] += g
        bad[at] += b
    if not good.sum() or not bad.sum():
        return 2.0
    lost = good[::-1].cumsum()[::-1] / good.sum()
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    allowed = np.flatnonzero(lost <= good_loss)
    gain = caught[allowed] - lost[allowed]
    return float(allowed[int(np.argmax(gain))]) / BINS if len(allowed) and gain.max() > 0 else 2.0


def isolate(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, trees: int = TREES, good_loss: float = GOOD_LOSS,
) -> DataFrame:
    """Base rules plus isolation forests on rule statistics.

    ``labels`` has ``id_col`` and ``label_col`` (1 good, 0 bad); a document labelled both ways counts as
    good, null labels and ids are left out. The forests are grown on the ``sample`` rows of least hash among those
    that pass the base, labelled or not; their thresholds use all labelled rows and cost ``good_loss`` of the good
    ones at most, together. ``kept`` asks each forest's score, ``anomaly`` is the highest of them.

    Returns the id, STATS' first five as longs, ``base_failed``, ``kept`` and ``anomaly``, one row per input row.
    A null or empty text has zeros and fails the base; repeated rows are judged alike; other columns are
    ignored. Base: fewer than 20 words, or over 30 % of the words in repeated 8-word windows.
    """
    stats = cut_lineage(with_stats(docs, [id_col], text_col), "stats").withColumn("f", F.array(*ratios()))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label_"))
    labelled = stats.join(known, id_col)
    fails = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))

    taken = stats.where(~fails).orderBy(F.xxhash64(id_col), "f").limit(sample).select("f").toPandas()["f"]
    points = np.array(taken.tolist(), np.float64).reshape(-1, FEATURES)
    forests = stats.sparkSession.sparkContext.broadcast([Forest(points[:, part], trees) for part in FORESTS])

    @F.pandas_udf("array<double>")
    def anomalies(features: pd.Series) -> pd.Series:
        points = np.array(features.tolist(), np.float64).reshape(-1, FEATURES)
        return pd.Series(list(np.stack([f.score(points[:, part]) for f, part in zip(forests.value, FORESTS, strict=True)], axis=1)))

    at = lambda i: F.floor(F.col("scores")[i] * BINS).cast("int")
    open_ = labelled.where(~fails).withColumn("scores", anomalies("f"))
    total, kept = None, ~F.col("base_failed")
    for i in range(len(FORESTS)):
        histogram = [tuple(r) for r in (
            open_.groupBy(at(i).alias("bin"))
            .agg(F.count_if(F.col("label_") == 1), F.count_if(F.col("label_") == 0)).collect()  # BINS + 1 rows at most
        )]
        good = sum(h[1] for h in histogram)
        total = good if total is None else total
        # What the forests before have cost counts; the rest may still be lost.
        limit = threshold(histogram, (good_loss * total - (total - good)) / good if good else 0.0)
        passes = at(i) / BINS < limit
        open_, kept = open_.where(passes), kept & passes
    return (
        stats.withColumn("scores", anomalies("f")).withColumn("base_failed", fails)
        .withColumn("kept", kept).withColumn("anomaly", F.array_max("scores"))
        .select(id_col, *STATS[:5], "base_failed", "kept", "anomaly")
    )


def op2_isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the base rules and the forest."""
    return isolate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
