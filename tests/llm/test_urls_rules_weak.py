"""URL filter, quality rules and weak-label classifier against brute force and labelled rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalpact.llm import rules, urls, weak

SF = "/root/testdata/sf0.01"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- URLs


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = re.split(r"[?#]", rest[cut:], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def brute_rule(host, path):
    fits = []
    for text, verdict in urls.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


def brute_score(text, labelled, order, strength):
    if not text:
        return 0.0
    total = 0.0
    for sign, model in ((1, 0), (-1, 1)):
        grams, contexts = {}, {}
        for t, m in labelled:
            if m == model:
                s = "\0" * order + t + "\1"
                for i in range(order, len(s)):
                    for k in range(order + 1):
                        grams[s[i - k:i + 1]] = grams.get(s[i - k:i + 1], 0) + 1
                        contexts[s[i - k:i]] = contexts.get(s[i - k:i], 0) + 1
        s = "\0" * order + text + "\1"
        for i in range(order, len(s)):
            p = 1 / 256
            for k in range(order + 1):
                p = (grams.get(s[i - k:i + 1], 0) + strength * p) / (contexts.get(s[i - k:i], 0) + strength)
            total += sign * math.log(p)
    return total / (len(text) + 1)


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Ä.Example.NET/en/x?y#z", "http://net", "http://net/", "https://a.net?x=/en/",
    "http://example.net/en/", "http://xexample.net/en/", "http://example.com/de/a", "http://example.com/DE/a", "http://m.org/fr/",
    "http://org/fr/x", "http://a://b/c", "http://u@h.net:80/p#q?r", "x://y\n.net/\nfoo?", "http://h" + "o" * 5000 + ".net/",
]


def test_url_parts_and_rules(spark):
    pages = rows(spark, [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[5], "x"), (3, URLS[3], "x")],
                 "page_id long, url string, host string")
    got = urls.filter_urls(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path) == brute_url(URLS[r.page_id])
            rule, verdict = brute_rule(r.host, r.path)
            assert r.rule == rule and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")


def test_url_scores_equal_plain_counts():
    random.seed(1)
    texts = ["".join(random.choice("ab/.é") for _ in range(random.randint(0, 9))) for _ in range(60)]
    labelled = [(t, i % 2) for i, t in enumerate(texts) if t]
    counts = np.zeros((2, 2, 1 << 18), np.float32)
    for t, m in labelled:
        grams, contexts, _ = urls._cells([t], 3, 1 << 18)
        np.add.at(counts[m, 0], grams.ravel(), 1)
        np.add.at(counts[m, 1], contexts.ravel(), 1)
    got = urls.scores(texts, counts, order=3)
    assert np.allclose(got, [brute_score(t, labelled, 3, urls.STRENGTH) for t in texts], atol=1e-6)


def test_url_models_separate_held_out_rows(spark):
    good = [f"http://good{i}.site/articles/story-{i}" for i in range(300)]
    bad = [f"http://win{i}.site/casino/spin-{i}" for i in range(300)]
    pages = rows(spark, list(enumerate(good + bad)), "page_id long, url string")
    label = F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") < 300, "allow").otherwise("block"))
    got = urls.filter_urls(pages, labels=label, rules=()).where("page_id % 3 <> 0").collect()
    assert sum((r.verdict == "allow") == (r.page_id < 300) for r in got) >= 0.98 * len(got)


def test_url_empty_tables_and_threshold(spark):
    assert urls.filter_urls(rows(spark, [], "page_id long, url string")).count() == 0
    assert urls.calibrate([]) == 0.0 and urls.calibrate([(1, 5, 0)]) == 0.0
    assert -urls.BOUND < urls.calibrate([(1000, 0, 5), (3000, 5, 0)]) < urls.BOUND


# --- rules


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


TEXTS = [
    None, "", " \n\t\x0b", "one", "a b " * 30, "x\ny\n\nx\n x\nx", "é ñ 漢字 | # <b> é", "a\xa0b c\x85d", "w " * 7, "w " * 8,
    "a b c d e f g h i a b c d e f g h j", "\r\na\r\na\r\n", "long" * 100_000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    assert rules.text_stats(text)[:5] == brute_stats(text)


def test_random_statistics():
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choice(["a ", "b ", "\n", "#", " ", "é", "c d "]) for _ in range(random.randint(0, 80)))
        assert rules.text_stats(text)[:5] == brute_stats(text)


def test_forest_paths_are_short_for_outliers():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    score = rules.Forest(points).score(points)
    assert score.argmax() == 500 and score[500] > 0.7 > np.median(score[:500])
    assert (rules.Forest(np.empty((0, 3))).score(points) == 0).all()
    assert len(set(rules.Forest(np.ones((40, 3))).score(points))) == 1


def test_threshold_bounds_the_loss_of_good_rows():
    assert rules.threshold([]) == 2.0 and rules.threshold([(5, 10, 0)]) == 2.0
    t = rules.threshold([(100, 990, 0), (900, 10, 0), (800, 0, 50)], 0.01)
    assert 100 / rules.BINS < t <= 800 / rules.BINS
    assert rules.threshold([(100, 50, 10), (900, 50, 10)], 0.01) == 2.0


def test_isolation_on_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.isolate(docs, labels).join(labels, "doc_id").where("NOT base_failed")
    kept = {r.quality: (r.kept, r.n) for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[1][0] >= 0.97 and kept[0][0] <= 0.2


def test_isolation_edge_cases(spark):
    docs = rows(spark, [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1), (1, "", 1)], "doc_id long, text string, kept int")
    labels = rows(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = rules.isolate(docs, labels)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"]
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        n, _, _, _, repeat = brute_stats(t)
        assert found[i].base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (found[i].base_failed and found[i].kept)
    assert rules.isolate(docs.limit(0), labels).count() == 0
    assert rules.isolate(docs, labels.limit(0)).count() == len(TEXTS) + 2


@pytest.mark.parametrize("fault", ["lines", "figures", "stutters", "repeats"])
def test_forest_sees_every_statistic(spark, fault):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(9))
    texts = []
    for i in range(600):
        lines = [[word() for _ in range(8)] for _ in range(12)]
        if i % 10 == 0:
            if fault == "lines":
                lines = [part for x in lines for part in (x, ["menu"])]
            elif fault == "figures":
                lines = [["".join(random.choice("0123456789") for _ in w) if j % 2 else w for j, w in enumerate(x)] for x in lines]
            elif fault == "stutters":
                lines = [[w for w in x[:4] for _ in range(2)] for x in lines]
            else:  # two copies of nine words: under 30 % of the text
                lines[1] = lines[8] = lines[1] + ["bead"]
        texts.append("\n".join(" ".join(x) for x in lines))
    docs = rows(spark, list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    got = rules.isolate(docs, labels).collect()
    assert not any(r.base_failed for r in got)
    assert sum(r.kept for r in got if r.doc_id % 10 == 0) <= 6
    assert sum(r.kept for r in got if r.doc_id % 10) >= 0.98 * 540


# --- weak labels


def test_estimation_trusts_specialists():
    votes = np.array([[1, 0], [1, 1], [-1, 0], [-1, -1], [0, 0]])
    rates, posterior, prior = weak.estimate(votes, np.array([500.0, 300, 40, 60, 100]))
    assert posterior[0] > 0.9 and posterior[1] > 0.9 and posterior[2] < 0.1 and posterior[3] < 0.1
    assert rates.shape == (2, 2, 3) and np.allclose(rates.sum(axis=2), 1) and 0.8 < prior < 0.95


def test_classifier_on_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = weak.classify(docs)
    assert scored.columns == [*docs.columns, "score", "kept"] and scored.count() == docs.count()
    kept = {r.quality: r.kept for r in scored.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] >= 0.98 and kept[0] <= 0.15


def test_classifier_edge_cases(spark):
    docs = rows(spark, [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1), (1, "", 1)], "doc_id long, text string, n int")
    got = weak.classify(docs).collect()
    assert len(got) == len(TEXTS) + 2 and all(not r.kept for r in got if not (r.text or "").strip(" \n\t\x0b"))
    assert weak.classify(docs.limit(0)).count() == 0
    assert weak.classify(docs.where("text IS NULL")).count() == 1
    with pytest.raises(ValueError):
        weak.classify(docs.withColumn("Score", F.lit(1)))
