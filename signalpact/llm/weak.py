"""Quality classifier from weak labels.

Overlapping heuristic labellers vote keep, reject or abstain. Expectation-maximisation over the counts of
all vote patterns estimates each labeller's accuracy and every pattern's posterior. The posteriors of a
bounded sample train a linear scorer over hashed features of the whole text, which judges every document.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpact.llm.rules import STATS, text_stats
from signalpact.llm.text import per_text, quoted, table, text_bytes
from signalpact.session import cut_lineage

#: Hashed dimensions of the linear scorer.
DIMS = 2048
#: Documents the scorer is trained on at most (least hash first).
SAMPLE = 6_000
#: Documents scoring at least this are kept.
KEEP_AT = 0.5
EM_ROUNDS, STEPS = 60, 300
#: Bytes hashed at once.
_BLOCK = 1 << 20
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _vote(reject: Column, keep: Column | None = None) -> Column:
    kept = F.when(keep, 1).otherwise(0) if keep is not None else F.lit(0)
    return F.when(reject, -1).otherwise(kept)


def labellers() -> dict[str, Column]:
    """Votes (1 keep, -1 reject, 0 abstain) of a row with STATS. Texts without words are left to the others."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    letters = F.greatest(F.col("n_letters"), F.lit(1))
    symbols, bars, marks = F.col("n_symbols") / words, F.col("n_bars") / words, F.col("n_marks") / words
    upper, repeats, length = F.col("n_upper") / letters, F.col("n_repeat_words") / words, F.col("word_chars") / words
    dups = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    plain = (symbols < 0.1) & (upper < 0.3) & (marks < 0.1) & (repeats < 0.3)
    return {
        "symbols": _vote(symbols > 0.25),
        "bars": _vote(bars > 0.15),
        "shouting": _vote(upper > 0.4),
        "marks": _vote(marks > 0.25),
        "repeats": _vote((repeats > 0.5) & (F.col("n_words") >= 40)),
        "stutters": _vote(F.col("n_stutters") / words > 0.25),
        "duplicate_lines": _vote((dups > 0.5) & (F.col("n_lines") >= 4)),
        "prose": _vote(~plain, plain),
        "plain_words": _vote((length < 1.5) | (length > 12), (length >= 2.5) & (length <= 9) & (symbols < 0.1)),
        "few_figures": _vote(F.col("n_digits") / chars > 0.3, (F.col("n_digits") / chars < 0.15) & (upper < 0.3) & (repeats < 0.3)),
    }


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """How each labeller votes on good and on bad documents, posterior of "good" per vote pattern, and its prior.

    Expectation-maximisation over pattern counts. Rates have the shape (labeller, bad or good, reject or
    abstain or keep): a labeller's accuracies are the rates of rejecting the bad and keeping the good, so
    one that knows a single fault is trusted when it rejects and not asked when it abstains. It starts
    from "any rejection is bad"; a mild prior says that good documents are seldom rejected.
    """
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)  # pattern, labeller, vote
    posterior = np.where((votes < 0).any(axis=1), 0.1, 0.95)
    belief = np.array([[1.0, 1.0, 1.0], [0.1, 1.45, 1.45]])
    rates, prior = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        for side, share in enumerate((1 - posterior, posterior)):
            mass = np.einsum("p,pjv->jv", counts * share, seen) + belief[side]
            rates[:, side] = mass / mass.sum(axis=1, keepdims=True)
        prior = float(np.clip((counts @ posterior + 1) / (counts.sum() + 2), 0.05, 0.95))
        ratio = np.einsum("pjv,jv->p", seen, np.log(rates[:, 1]) - np.log(rates[:, 0]))
        posterior = 1 / (1 + np.exp(-np.clip(ratio + math.log(prior / (1 - prior)), -50, 50)))
    return rates, posterior, prior


def hashed_features(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Unit-length hashed features of one whole text: byte 3-grams with case and figures, and rule statistics.

    Letters beyond ASCII, lower case, upper case and figures are told apart by class in one half of the
    n-grams, so that the scorer sees shape as well as spelling. A text without words has only the bins of its zeros.
    """
    out = np.zeros(dims, np.float32)
    data = text_bytes(text)
    stats = dict(zip(STATS, text_stats(text), strict=True))
    half = dims // 2 - 32
    for i in range(0, len(data), _BLOCK):
        b = np.frombuffer(data, np.uint8, min(_BLOCK + 2, len(data) - i), i)
        if len(b) < 3:
            break
        for offset, codes in ((0, b), (half, _SHAPE[b])):
            codes = codes.astype(np.uint32)
            h = codes[:-2] * _MUL[0] ^ codes[1:-1] * _MUL[1] ^ codes[2:] * _MUL[2]
            h ^= h >> np.uint32(15)
            out[offset:offset + half] += np.bincount((h * _MUL[0] >> np.uint32(8)) % np.uint32(half), minlength=half)
    if len(data) >= 3:
        out = np.sqrt(out / max(float(out.sum()), 1e-9))
    words, lines = max(stats["n_words"], 1), max(stats["n_lines"], 1)
    for k, value in enumerate((
        stats["n_repeat_words"] / words, stats["n_dup_lines"] / lines, stats["n_symbols"] / words,
        stats["n_upper"] / max(stats["n_letters"], 1), stats["n_marks"] / words, stats["n_bars"] / words,
        stats["n_digits"] / max(stats["word_chars"], 1), stats["n_stutters"] / words,
    )):
        out[2 * half + 4 * k + min(3, int(value * 8))] = 1.0  # one of four bins: under 1/8, 1/4, 3/8 or more
    return out


_SHAPE = np.zeros(256, np.uint8)
for _code in range(256):
    _SHAPE[_code] = (
        1 if 97 <= _code <= 122 else 2 if 65 <= _code <= 90 else 3 if 48 <= _code <= 57 else 4 if _code >= 128
        else 5 if _code in (9, 10, 11, 12, 13, 32) else _code
    )


def train(features: np.ndarray, posterior: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer fitted to soft labels, the rarer side weighted up."""
    x = features.astype(np.float32)
    weights, offset = np.zeros(x.shape[1], np.float32), 0.0
    if not len(x):
        return weights, offset
    keep = float(np.clip(posterior.mean(), 0.02, 0.98))
    each = np.where(posterior >= 0.5, 0.5 / keep, 0.5 / (1 - keep)).astype(np.float32)
    each /= each.sum()
    velocity, push = np.zeros_like(weights), 0.0
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + offset, -30, 30)))
        gap = (each * (p - posterior)).astype(np.float32)
        rate = 4.0 / (1 + step / 200)
        velocity = 0.9 * velocity - rate * (gap @ x + 1e-4 * weights)
        push = 0.9 * push - rate * float(gap.sum())
        weights += velocity
        offset += push
    return weights, offset


def classify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT,
    dims: int = DIMS, sample: int = SAMPLE, added: tuple[str, str] = ("score", "kept"),
) -> DataFrame:
    """Every row of ``docs`` with ``score`` and ``kept`` (or the names ``added``) added.

    The columns of ``docs`` stay; added names that clash with one of them (in any case) are an error, so a
    caller who has such columns names others.
    A null or empty text has no words: it casts no votes and is never kept. Repeated rows are judged alike. An empty table gives no rows.

    Two passes over the texts: votes (counted per pattern, at most 3 ** labellers rows to the driver) and
    scores. The scorer is trained on ``sample`` documents at most.
    """
    taken = {c.lower() for c in docs.columns}
    if taken & {n.lower() for n in added}:
        raise ValueError(f"docs already has a column {added[0]} or {added[1]}")
    text = F.col(quoted(text_col))
    stamped = docs.select(F.xxhash64(F.col(quoted(id_col)).cast("string"), text).alias("_key"), text.alias("text"))
    context = docs.sparkSession.sparkContext.broadcast(fit(stamped, "text", dims, sample))

    def make():
        weights, offset = context.value

        def work(texts: list) -> dict:
            x = np.array([hashed_features(t, dims) for t in texts], np.float32).reshape(len(texts), dims)
            score = 1 / (1 + np.exp(-np.clip(x @ weights + offset, -30, 30).astype(np.float64)))
            words = [bool(text_bytes(t).split(None, 1)) for t in texts]
            return {added[0]: score, added[1]: [bool(w and s >= keep_at) for w, s in zip(words, score, strict=True)]}

        return work

    return per_text(docs, docs.columns, text_col, make, f"{quoted(added[0])} double, {quoted(added[1])} boolean")


def fit(stamped: DataFrame, text_col: str, dims: int, sample: int) -> tuple[np.ndarray, float]:
    """Weights and offset of the scorer, learned from all rows (``_key`` orders the sample)."""
    def make():
        def work(texts: list) -> dict:
            rows = np.array([text_stats(t) for t in texts], np.int64).reshape(len(texts), len(STATS))
            return {name: rows[:, i] for i, name in enumerate(STATS)}
        return work

    names = labellers()
    stats = per_text(stamped, ["_key"], text_col, make, ", ".join(f"{c} long" for c in STATS))
    voted = cut_lineage(stats.where("n_words > 0").select("_key", F.array(*(c.cast("int") for c in names.values())).alias("votes")), "votes")
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** labellers at most
    if not patterns:
        return np.zeros(dims, np.float32), 0.0
    votes = np.array([r["votes"] for r in patterns], np.int64)
    _, posterior, _ = estimate(votes, np.array([r["n"] for r in patterns], np.float64))
    known = {tuple(v): float(p) for v, p in zip(votes.tolist(), posterior, strict=True)}
    picked = voted.groupBy("_key").agg(F.first("votes").alias("votes")).orderBy("_key").limit(sample)
    chosen = stamped.select("_key", text_col).join(F.broadcast(picked), "_key").dropDuplicates(["_key"])  # sample rows at most

    def features():
        return lambda texts: {"x": [hashed_features(t, dims).astype("<f2").tobytes() for t in texts]}

    rows = per_text(chosen.withColumn("_text", F.col(text_col)), ["votes"], "_text", features, "x binary").collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f2").reshape(len(rows), dims)
    return train(x, np.array([known[tuple(r["votes"])] for r in rows]))


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of all documents."""
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "score", "kept")
