"""Fingerprints against sets of paragraph digests in plain Python."""

import hashlib
import random
import re

import pytest

from signalpact.llm import fingerprints as fp

random.seed(11)


def keys(text):
    parts = (p.strip(" ") for p in re.findall(fp.PARAGRAPH, text))
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in parts if p}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(keys(text), keys(edited)), likeness(keys(text), keys(after))))
    return sorted(out, key=repr)


def texts(n):
    sentence = lambda: " ".join(random.choice(["one", "zwei", "três", "漢字😀", "x."]) for _ in range(random.randint(1, 6)))
    base = [" ".join(sentence() + random.choice([".", "!", "\n", "?!", ""]) for _ in range(random.randint(1, 60))) for _ in range(n)]
    return base + [base[0]] * 3 + [base[1] + " More.", None, "", "...", " \n \n", "no end", "Same. Same. Same.", "a\tb.\r\nc" * 400]


@pytest.mark.parametrize("per_range", [4096, 7, 1])
def test_fingerprints_equal_plain_sets(spark, per_range, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", per_range)
    rows = [(random.choice([None, *range(-50, 1000)]) if k % 9 == 0 else 3 * k, t) for k, t in enumerate(texts(60))]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, own string, id string, n_chars int").repartition(4)
    got = fp.fingerprint(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=repr) == expected(rows)
    same = [r.fingerprint for r in got if r.doc_id is not None and next(t for i, t in rows if i == r.doc_id) == rows[0][1]]
    assert len(set(same)) == 1


def test_larger_tables_recover_every_difference(spark):
    cases = []
    for n in (0, 1, 2, 5, 9, 30, 200, 3000):
        pool = [random.getrandbits(fp.BITS) for _ in range(2 * n)]
        cases += [(pool[:n], pool[:n]), (pool[:n], pool[n // 10:n + n // 10]), (pool[:n], pool[n:])]
    close = [(1 << 40) + k for k in range(40)]  # digests that differ in their last bits only
    cases.append((close[:25], close[10:]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, x array<bigint>, y array<bigint>").repartition(8)
    got = df.selectExpr("i", f"{fp.resolve('x', 'y')} AS r", f"{fp.peel(fp.subtract(fp.sketch('x'), fp.sketch('y')))} AS first").collect()
    for r in got:
        a, b = map(set, cases[r.i])
        assert tuple(r.r) == (True, len(a - b), len(b - a))
        assert not r.first.ok or tuple(r.first)[1:] == (len(a - b), len(b - a))
    assert all(r.first.ok for r in got if len(set(cases[r.i][0]) ^ set(cases[r.i][1])) <= 1)


def test_fingerprint_edge_cases(spark):
    assert fp.fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    lone = fp.fingerprint(spark.createDataFrame([(4, "One. Two.")], "doc_id int, text string")).first()
    assert lone.near_next == 1.0 and lone.n_chars == 9
    assert fp.fingerprint(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).where("near_next = 1 AND n_chars = 0").count() == 3
