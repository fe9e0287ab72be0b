"""Exact vector search, personal data and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalpact.llm import pii, vafile
from signalpact.llm.registry import ORACLE, QUERIES
from signalpact.session import scratch_path
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, SF, name, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_its_table(spark, name):
    source, key = {"op1_": ("pages", "page_id"), "op13": ("conversations", "conv_id")}.get(name[:4], ("documents", "doc_id"))
    rows = QUERIES[name](spark, SF)
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{SF}/{source}.parquet").select(key).distinct().count()


# --- vectors


def brute_top(vectors, asked, k=10):
    clean = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean.setdefault(i, set()).add(tuple(int(np.floor(1024 * float(x))) for x in v))
    out = set()
    for i in clean:
        if asked(i):
            for q in clean[i]:
                found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j in clean if j != i for v in clean[j] if len(v) == len(q))
                out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("cells,blocks", [(64, (8192, 256)), (2, (50, 3))])
def test_search_is_exact(spark, cells, blocks, monkeypatch):
    monkeypatch.setattr(vafile, "DATA_BLOCK", blocks[0])
    monkeypatch.setattr(vafile, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    hot = [float(x) for x in rng.normal(size=6)]
    vectors = [(i, hot if i % 3 == 0 else [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    vectors += [(500, None), (510, [1.0, None] * 3), (520, [float("nan")] * 6), (530, [float("inf")] * 6), (540, [1.0, 2.0]), (550, [3.0, 1.0]),
                (560, []), (None, hot), (600, [1e6] * 6), (610, [-1e6] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    got = {tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 10 == 0, cells=cells).collect()}
    assert got == brute_top(vectors, lambda i: i % 10 == 0)


def test_search_edge_cases(spark):
    df = spark.createDataFrame([(10, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in vafile.top_k(df, F.col("vec_id") == 10).collect()} == {(10, 1, 20, 1024 * 2048)}
    assert vafile.top_k(df.limit(0), F.lit(True)).count() == 0
    assert vafile.top_k(df, F.lit(False)).count() == 0
    assert vafile.top_k(df.union(df), F.lit(True)).count() == 2


def test_bounds_hold():
    rng = np.random.default_rng(6)
    v, q = rng.integers(-900, 900, (200, 5)), rng.integers(-900, 900, (20, 5))
    edges = np.array([-901, -300, 0, 10, 901])
    lower, upper = vafile.bounds(q, vafile.quantise(v, edges).reshape(v.shape), edges)
    assert (lower <= q @ v.T).all() and (upper >= q @ v.T).all()


# --- personal data


def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_patterns():
    random.seed(7)
    parts = ["a", "B", ".", "@", "1", "22", "255", "+", "-", " ", "(", ")", "%", "_", "é", "4539578763621486", "0", "٣", "1.2.3.4", "a@b.c"]
    for _ in range(8000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans(None) == [] == pii.base_spans("1" * 300_000) == pii.base_spans("a" * 300_000 + "@")
    assert pii.base_spans("+1" + " " * 300_000) == []


def corpus():
    docs = [(i, f"some plain text number{i} with the word common inside it") for i in range(200)]
    docs += [(300 + i, f"please write to zorblax quickly ann{i // 4}@mail.org common or call") for i in range(4)]
    docs += [(400, None), (401, ""), (402, "1.2.3.4 alone"), (403, "zorblax without an address"), (404, "x" * 100_000 + " 1.2.3.4")]
    return docs


@pytest.mark.parametrize("bound", [pii.BROADCAST_BYTES, 0])
def test_terms_that_disclose(spark, bound, monkeypatch):
    monkeypatch.setattr(pii, "BROADCAST_BYTES", bound)
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus()], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: [tuple(s[k] for k in ("start", "kind", "end")) for s in r.spans] for r in pii.find_spans(df).collect()}
    texts = dict(corpus())
    marked = {texts[i][a:b] for i, spans in got.items() for a, k, b in spans if k == len(pii.KINDS)}
    assert {"zorblax", "quickly"} <= marked and not marked & {"common", "text", "alone"}
    assert got[403] == [] and got[400] == [] and [s[1] for s in got[402]] == [1]
    for i, spans in got.items():
        assert [s for s in spans if s[1] < 4] == brute_spans(texts[i]) and spans == sorted(spans)
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and clean.count() == len(corpus())
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[402] == "[IP] alone" and out[400] is None and "[EMAIL]" in out[300] and "zorblax" not in out[300]
    assert out[5] == texts[5] and "zorblax" in out[403]


def test_masking_and_empty_table(spark):
    assert pii.masked("Call Bob 12 now", [(5, 4, 8), (9, 4, 11), (12, 4, 15)]) == "Call [NAME] 00 "
    assert pii.masked("+4539578763621486", [(0, 3, 17), (1, 2, 17)]) == "[PHONE]"
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_spans(df).count() == 0 and pii.sanitise(df).count() == 0
    nothing = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")], "doc_id long, text string")
    assert pii.find_spans(nothing).count() == 3


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        path = scratch_path(spark, "pipeline-test")
        after.write.parquet(path)
        after = spark.read.parquet(path)
        ids_before, ids_after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (before, after))
        if i < 4:
            assert after.columns == columns
        if i < 2:
            assert ids_after < ids_before
        else:
            assert ids_after == ids_before
        before = after if i < 4 else before
    texts = [r.text for r in before.collect()]
    assert not any(s for t in texts for s in brute_spans(t))
    assert sum(r.length for r in after.collect()) >= len(texts)


def test_stages_keep_columns_of_any_name(spark):
    names = ["id", "rid", "score", "kept", "_text", "_key", "_path", "_at", "_file", "_rid", "_both", "_ranges", "_clean", "_spans",
             "Label", "a.b", "component"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    path = scratch_path(spark, "names")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = after.select("doc_id", *(F.col(f"`{n}`") for n in names)).collect()
        assert rows and all(tuple(r)[1:] == tuple(f"{n}{r.doc_id}" for n in names) for r in rows)


def test_pipeline_run(spark):
    first, second = (corpus_pipeline.run(spark, SF) for _ in range(2))
    assert first.count() == second.count() > 0
    digest = [hashlib.sha256(str(sorted((r.doc_id, r.piece, r.ids_crc32) for r in d.collect())).encode()).hexdigest() for d in (first, second)]
    assert digest[0] == digest[1]
