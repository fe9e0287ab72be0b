"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalpact.llm import near, substrings

WORD = r"[^\x20\x09-\x0D]+"


def soup(seed, n, edits, words="abcdefghij"):
    """Texts of few words with copies, edited copies and shared passages."""
    random.seed(seed)
    base = [" ".join(random.choice(words) + random.choice(words) for _ in range(random.randint(0, 70))) for _ in range(n // 8)]
    out = []
    for _ in range(n):
        text = random.choice(base).split() + (random.choice(base).split() if random.random() < 0.3 else [])
        for _ in range(random.randint(0, edits)):
            if text:
                text[random.randrange(len(text))] = random.choice("XYZ")
        out.append(random.choice([" ", "\n", "  "]).join(text))
    return out


def shingles(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    label = {i: i for i, _ in docs}
    moved = True
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and 100 * len(a & b) >= 75 * len(a | b)]
    while moved:
        moved = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                moved = True
    return {i: (len(s), label[i], label[i] == i) for i, s in sets}


@pytest.mark.parametrize("seed,star", [(1, 256), (2, 3)])
def test_near_duplicates(spark, seed, star, monkeypatch):
    monkeypatch.setattr(near, "STAR", star)
    if seed == 2:
        monkeypatch.setattr(near, "BROADCAST_BYTES", 0)
    texts = soup(seed, 240, 4) + [None, "", " \n", "A b", "a  B", "one two three four five", "ONE two three four five", "é " * 5000]
    docs = list(enumerate(texts))
    random.shuffle(docs)
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, component_id long").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.link(df).collect()}
    want = brute_components(docs)
    assert got == want
    kept = near.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_near_edge_cases(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, "x y z"), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near.link(df).collect()), key=str)
    assert got == sorted([(5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, False), (9, 1, 9, True), (9, 0, 9, True), (None, 0, None, True)], key=str)
    assert near.keep_first(df).count() == 4
    assert near.link(df.limit(0)).count() == 0 and near.keep_first(df.limit(0)).count() == 0
    assert near.link(df.where("text IS NULL")).count() == 2
    assert near.keep_first(df.withColumn("RID", F.lit(1))).columns == ["doc_id", "text", "RID"]


def test_registers_estimate_and_bands():
    rng = np.random.default_rng(1)
    for common, own in ((6, 1), (60, 10), (900, 150)):
        estimates, met = [], 0
        for _ in range(300):
            all_ = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
            a, b = near.sketch(np.sort(all_[:common + own])), near.sketch(np.sort(np.concatenate([all_[:common], all_[common + own:]])))
            estimates.append(near.estimate(a, b))
            met += bool((near.bands(a) == near.bands(b)).any())
        assert abs(np.mean(estimates) - common / (common + 2 * own)) < 0.02 and met == 300
    apart = [near.sketch(rng.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(40)]
    assert np.mean([(a == b).mean() for a, b in zip(apart, apart[1:], strict=False)]) < 0.002
    assert (near.sketch(np.empty(0, np.uint64)) == 0xFFFF).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in near.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_repeats(docs, length=20):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        words = re.findall(WORD, text or "")
        gone = [False] * len(words)
        for at in range(len(words) - length + 1):
            window = tuple(words[at:at + length])
            if window in seen:
                gone[at:at + length] = [True] * length
            seen.add(window)
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,bound", [(3, substrings.BROADCAST_BYTES), (4, 0)])
def test_substrings(spark, seed, bound, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", bound)
    texts = soup(seed, 300, 3, "abc") + [None, "", "w " * 19, "w " * 20, "w " * 21, "q " * 500, "q " * 499, "é\x85é " * 300, "z" * 200_000]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.kept_digests(df).collect()}
    want = brute_repeats(docs)
    assert got == want and sum(w[1] for w in want.values()) > 3000
    clean = substrings.drop_repeats(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        assert hashlib.sha256(" ".join(re.findall(WORD, r.text or "")).encode()).hexdigest() == want[r.doc_id][2]
        assert (r.text is None) == (texts[r.doc_id] is None)


def test_substring_edge_cases(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(None, passage), (3, "a " + passage + " b"), (3, passage), (1, "short")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.kept_digests(df).collect()}
    assert got[(None, 25)] == 25 and got[(1, 1)] == 0
    assert sorted([got[(3, 27)], got[(3, 25)]]) == [0, 25]
    assert substrings.kept_digests(df.limit(0)).count() == 0 and substrings.drop_repeats(df.limit(0)).count() == 0
    assert substrings.cut("  a b  c\nd ", [{"first": 1, "last": 1}], 2) == "  a\nd "
    assert substrings.cut("a b", [{"first": 0, "last": 0}], 2) == ""


def test_every_long_window_selects_the_same_anchor():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**63, 40).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 2**63, 33).astype(np.uint64), passage])
    b = np.concatenate([passage, rng.integers(0, 2**63, 9).astype(np.uint64)])
    keys = [set(substrings.anchors(x)[0].tolist()) for x in (a, b)]
    assert keys[0] & keys[1]
    _, _, first, last = substrings.anchors(a)
    assert first[0] == 0 and last[-1] == len(a) - 20 and (first[1:] == last[:-1] + 1).all()


# --- row numbers


@pytest.mark.parametrize("module", [substrings, near])
def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path, monkeypatch, module):
    """Executors come and go between two jobs, and splits follow the cores: here their size changes at every cut."""
    path = str(tmp_path / "docs")
    texts = soup(11, 240, 2)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.option(
        "parquet.block.size", 4096).parquet(path)
    docs = spark.read.parquet(path)
    query = (lambda: substrings.kept_digests(docs)) if module is substrings else (lambda: near.link(docs))
    want = sorted(map(tuple, query().collect()))
    key, cut, calls = "spark.sql.files.maxPartitionBytes", module.cut_lineage, []
    before = spark.conf.get(key)

    def moving(df, purpose):
        out = cut(df, purpose)
        calls.append(purpose)
        spark.conf.set(key, ("9000", "100000000", "5000")[len(calls) % 3])
        return out

    monkeypatch.setattr(module, "cut_lineage", moving)
    try:
        assert sorted(map(tuple, query().collect())) == want
    finally:
        spark.conf.set(key, before)
    assert calls
