"""Alignment of two tokenizers against a plain loop over all links."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from signalpact.llm import alignment
from signalpact.llm.text import narrow

random.seed(12)
TEXTS = [None, "", " ", "a", "<s> </s> <|endoftext|> <0x41> <unk>", "▁ x", "it's  WE'RE\n\n ok", "é" * 50, "漢字😀 the thwhrest",
         "same words again", "same words again", "the the the the", "x" * 400, "ﬁ ligature ① ａ", "tab\tand\r\nline end\x00"] + [
    " ".join(random.choice(["the", "whrest", "ouandthe", "Ünging", "12,345", "token", "l'eau", "\n", "zörblax", "e"]) for _ in range(random.randint(1, 60)))
    for _ in range(120)]


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.Vocabularies(*alignment.default_paths())


def plain(v, texts):
    """Expected rows by loops: tokens, cuts, links, then counts over texts."""
    rows, holds = [], Counter()
    for text in texts:
        groups = []
        if text:
            raw = (" " + text).encode()
            a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
            if b"".join(v.a_bytes[i] for i in a) == raw == b"".join(v.b_bytes[i] for i in b):
                i = j = at_a = at_b = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        left.append(a[i])
                        at_a += len(v.a_bytes[a[i]])
                        i += 1
                    else:
                        right.append(b[j])
                        at_b += len(v.b_bytes[b[j]])
                        j += 1
                    if at_a == at_b and left and right:
                        groups.append((left, right))
                        left, right = [], []
        links = [(x, y) for left, right in groups for x in left for y in right]
        holds.update(set(links))
        rows.append((groups, links))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for groups, links in rows:
        told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
                    sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), told))
    return out


@pytest.mark.parametrize("chunk", [200, 1 << 23])
def test_alignment_equals_plain_loops(spark, vocabularies, chunk, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "SLICE", 300)
    want = plain(vocabularies, TEXTS)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk string, n_a int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs).collect()}
    assert got == dict(enumerate(want))
    hashed = {r.doc_id: r.groups for r in alignment.align(docs, digest=True).collect()}
    assert hashed == {i: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for i, w in enumerate(want)}


def test_alignment_edge_cases(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nothing = alignment.align(spark.createDataFrame([(None, None), (7, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in nothing) == [(0, 0, 0, 0, 0, 0, 0, ""), (7, 0, 0, 0, 0, 0, 0, "")]
    rows = alignment.align(spark.createDataFrame([("a", "one two"), ("a", "one two"), (None, "one two")], "k string, t string"), "k", "t").collect()
    assert [r.count_sum for r in rows] == [3 * r.n_links for r in rows] and {r.k for r in rows} == {"a", None}
    assert len({tuple(r)[1:] for r in rows}) == 1


def test_identity_map(vocabularies):
    v = vocabularies
    told = [(v.a_bytes[a], v.b_bytes[b]) for a, b in enumerate(v.same.tolist()) if b >= 0]
    assert len(told) > 10_000 and all(x == y for x, y in told)
    assert not v.b.is_byte(int(v.same[v.a_bytes.index(b"e")]))


def test_listed_classes_split_as_the_pattern_does():
    random.seed(7)
    texts = ["".join(chr(random.randint(1, 0x52F)) for _ in range(300)) for _ in range(60)]
    texts += ["".join(random.choice("ab \n\t\x1c\x85\xa01\u00b2'sdl,\u0301\u0410") for _ in range(300)) for _ in range(60)]
    for pattern in (alignment.default_pattern(), r"\n|'s|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        assert [re.findall(narrow(pattern), t) for t in texts] == [regex.findall(pattern, t) for t in texts]


def test_bytes_of_each_text_are_read_from_one_table():
    size = np.array([1, 0, 3])
    ids = [np.array(x, np.int32) for x in ([2, 0, 1], [], [0, 0])]
    assert list(alignment._spelled(ids, np.frombuffer(b"abcd", np.uint8), size)) == [b"bcda", b"", b"aa"]
    assert list(alignment._spelled([], np.frombuffer(b"abcd", np.uint8), size)) == []
