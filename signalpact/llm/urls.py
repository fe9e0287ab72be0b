"""URL filter: host and path rules, then a ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, are counted over all labelled
rows. A character's probability under each is interpolated from the longest context down to none, so an
unseen context falls back by itself. The verdict compares the length-normalised log-likelihood difference
with a threshold that is calibrated on labelled URLs held out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpact.llm.text import mix, signed, table

#: (host/path, verdict) of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Characters of context of the longest order.
ORDER = 4
#: Hashed count cells per model: the size of what is broadcast, whatever the input's size.
CELLS = 1 << 18
#: Weight of the next lower order in the interpolation, in observations.
STRENGTH = 2.0
#: Every so many labelled URLs (by hash) are held out for the threshold.
HELD_OUT = 5
#: Resolution of the score histogram the threshold is taken from, and its outer bound.
BINS, BOUND = 4000, 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = 2048
_SALT = np.uint64(0x9E3779B97F4A7C15)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``, else nulls.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit(f".{name}"))) & F.startswith(
            F.col("path"), F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _cells(texts: list[str], order: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of every character's gram and of its context per order, and the row of every character.

    Texts are led in by ``order`` start marks and closed by an end mark. The shapes are
    (order + 1, characters).
    """
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
    joined = "".join("\0" * order + t + "\1" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths + order) - lengths
    rows = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    grams = np.empty((order + 1, len(at)), np.int64)
    contexts = np.empty((order + 1, len(at)), np.int64)
    running = np.zeros(len(at), np.uint64)  # hash of the context so far, nearest character first
    mask = np.uint64(cells - 1)
    for k in range(order + 1):
        if k:
            running = mix(running * _SALT + codes[at - k])
        contexts[k] = signed(mix(running + np.uint64(2 * k)) & mask)
        grams[k] = signed(mix((running + np.uint64(2 * k + 1)) * _SALT + codes[at]) & mask)
    return grams, contexts, rows


def _count(batches: Iterator[pd.DataFrame], order: int, cells: int) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 2, cells), np.int64)  # model, gram or context, cell
    for batch in batches:
        for model, texts in batch.groupby("model", sort=False)["chars"]:
            values = texts.tolist()
            for i in range(0, len(values), _ROWS):
                grams, contexts, _ = _cells(values[i:i + _ROWS], order, cells)
                counts[model, 0] += np.bincount(grams.ravel(), minlength=cells)
                counts[model, 1] += np.bincount(contexts.ravel(), minlength=cells)
    for kind in range(2):
        at = np.flatnonzero(counts[:, kind].any(axis=0))
        yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "cell": at.astype(np.int32),
                            "accepted": counts[0, kind, at], "rejected": counts[1, kind, at]})


def fit(labelled: DataFrame, order: int = ORDER, cells: int = CELLS) -> np.ndarray:
    """Counts of both models over all rows of (``chars`` string, ``model`` 0 accepted or 1 rejected).

    Each task sums its own counts; at most 2 x ``cells`` sums reach the driver. Shape: model, kind, cell.
    """
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    sums = (
        labelled.mapInPandas(lambda b: _count(b, order, cells), "kind int, cell int, accepted long, rejected long")
        .groupBy("kind", "cell").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")).toPandas()
    )
    counts = np.zeros((2, 2, cells), np.float32)
    kind, cell = sums["kind"].to_numpy(np.int64), sums["cell"].to_numpy(np.int64)
    counts[0, kind, cell] = sums["accepted"]
    counts[1, kind, cell] = sums["rejected"]
    return counts


def scores(texts: list[str], counts: np.ndarray, order: int = ORDER, strength: float = STRENGTH) -> np.ndarray:
    """Mean log-likelihood of each text under the accepted model minus that under the rejected one.

    P_k = (n(context, c) + s * P_(k-1)) / (n(context) + s), down from a uniform 1/256. An empty text is 0.
    """
    out = np.zeros(len(texts))
    for i in range(0, len(texts), _ROWS):
        part = texts[i:i + _ROWS]
        grams, contexts, rows = _cells(part, order, counts.shape[2])
        logs = []
        for model in range(2):
            p = np.full(len(rows), 1 / 256)
            for k in range(order + 1):
                seen = counts[model, 0, grams[k]].astype(np.float64)
                total = np.maximum(counts[model, 1, contexts[k]], seen)  # cells are shared by chance
                p = (seen + strength * p) / (total + strength)
            logs.append(np.log(p))
        lengths = np.bincount(rows, minlength=len(part))
        out[i:i + len(part)] = np.bincount(rows, logs[0] - logs[1], len(part)) / lengths
    out[[not t for t in texts]] = 0.0
    return out


def calibrate(histogram: list[tuple[int, int, int]]) -> float:
    """Threshold with the highest balanced accuracy from (bin, accepted, rejected); 0 without both labels.

    Of equally good thresholds the one in the middle of the first run is taken.
    """
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for at, a, r in histogram:
        good[at] += a
        bad[at] += r
    if not good.sum() or not bad.sum():
        return 0.0
    # Threshold at the lower edge of bin i: accepted from i on, rejected before it.
    right = (good[::-1].cumsum()[::-1] / good.sum()) + np.concatenate([[0], bad.cumsum()[:-1]]) / bad.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    run = best[: int(np.argmax(np.diff(best, append=best[-1] + 2) > 1)) + 1]
    return float(run[len(run) // 2] * (2 * BOUND / BINS) - BOUND)


def filter_urls(
    pages: DataFrame, labels: Column | None = None, rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id", url_col: str = "url", order: int = ORDER, cells: int = CELLS,
) -> DataFrame:
    """Judge every URL: the longest fitting rule decides, else the language models.

    ``labels`` is an expression over ``pages`` giving ``allow`` or ``block`` for labelled rows; without one
    the rules label the rows they fit. The models read host and path, not the query string.

    Returns ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (positive: more like the
    accepted URLs), one row per input row. A null URL or one without ``://`` has an empty host and path
    and score 0. With no labelled rows every score is 0 and passes. Repeated rows are counted and
    returned one by one; other columns of ``pages`` are ignored.
    """
    judged = match_rules(
        pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"),
                     (labels if labels is not None else F.lit(None).cast("string")).alias("label")),
        rules,
    )
    judged = judged.withColumn("label", F.coalesce("label", "rule_verdict")) if labels is None else judged
    chars = F.concat("host", "path")
    model = F.when(F.col("label") == "allow", 0).when(F.col("label") == "block", 1)
    labelled = judged.select(chars.alias("chars"), model.alias("model")).where("model IS NOT NULL AND chars <> ''")
    held = F.pmod(F.xxhash64("chars"), F.lit(HELD_OUT)) == 0
    counts = pages.sparkSession.sparkContext.broadcast(fit(labelled.where(~held), order, cells))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(texts.tolist(), counts.value, order))

    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + BOUND) * (BINS / (2 * BOUND)))))
    histogram = (
        labelled.where(held).withColumn("score", score("chars")).groupBy(at.cast("int").alias("bin"))
        .agg(F.count_if(F.col("model") == 0), F.count_if(F.col("model") == 1)).collect()  # BINS rows at most
    )
    threshold = calibrate([tuple(r) for r in histogram])
    return (
        judged.withColumn("score", score(chars))
        .withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")))
        .select(id_col, "host", "path", "rule", "verdict", "score")
    )


def op1_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, judged by the fixed rules and by models of the URLs that the rules decide."""
    return filter_urls(table(spark, sf_dir, "pages"))
