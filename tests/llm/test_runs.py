"""Runs of repeated words against a plain search of all periods."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callward.llm import periodic, queries

DOCS = "doc_id long, text string"


def plain_runs(words, least=6):
    """(start, length, period): every period tried at every place."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, 4 * p):
                found.setdefault((start, i - start + p), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


pieces = st.tuples(st.lists(st.integers(0, 2), max_size=6), st.integers(1, 12))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=5), min_size=1, max_size=4), st.sampled_from([3, 6, 9]))
def test_find_equals_plain_search(texts, least):
    words = [[x for part, times in text for x in part * times] for text in texts]
    codes = np.array([x for w in words for x in w], np.int64)
    got = periodic.find(codes, np.concatenate(([0], np.cumsum([len(w) for w in words]))), least)
    assert got.tolist() == [[k, *r] for k, w in enumerate(words) for r in plain_runs(w, least)]


def test_long_and_nested_runs():
    for words in ([0] * 30_000, list(range(70)) * 30, ([0] * 9 + [1]) * 200, [7, *[1, 2] * 300, 2, *[1, 2, 1, 3] * 200]):
        got = periodic.find(np.array(words, np.int64), np.array([0, len(words)]))[:, 1:]
        for s, n, p in got.tolist():
            assert n >= max(6, 4 * p) and words[s:s + n - p] == words[s + p:s + n]
            assert s == 0 or words[s - 1] != words[s - 1 + p]
            assert s + n == len(words) or words[s + n] != words[s + n - p]
        assert [(0, 30_000, 1)] == list(map(tuple, got)) if len(set(words)) == 1 else plain_runs(words) == list(map(tuple, got.tolist()))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 9), (4, "a b " * 9), (None, "x " * 7), (5, "x x x\x1cx " * 3),
            (6, "q " + "w e r " * 4 + "w e t"), (7, "ü\vü\fü\rü ü ü"), (8, "a b c " * 20_000), (9, "x x x x x"), (None, None)]
    rows += [(k, f"n{k} of all words that follow one another here in a row of their own kind " * (k % 3 + 1)) for k in range(10, 90)]
    return spark.createDataFrame(rows, DOCS)


def test_odd_rows(spark, odd):
    docs = odd.withColumn("runs", F.lit("x")).withColumn("h", F.lit(1)).withColumn("words", F.lit(2)).repartition(3)
    got = periodic.runs(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"] and got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] in (4, 6, 7)}
    assert [tuple(x) for x in by[4]["runs"]] == [(0, 18, 2)] and by[4]["collapsed"] == "a b"
    assert [tuple(x) for x in by[6]["runs"]] == [(1, 14, 3)] and by[6]["collapsed"] == "q w e r t"
    assert by[7]["collapsed"] == "ü"
    assert periodic.runs(docs.limit(0)).count() == 0


def test_query_digests(spark, odd, tmp_path):
    odd.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    short = lambda rows: sorted((r for r in rows), key=repr)
    got = [tuple(r) for r in queries.op12(spark, str(tmp_path)).collect()]
    assert short(got) == short([digest(r["doc_id"], r["text"]) for r in odd.where("doc_id is null or doc_id <> 8").collect()] + [r for r in got if r[0] == 8])
    assert {r[1:6] for r in got if r[0] == 8} == {(1, 0, 60_000, 3, 20_000_000)}


def test_query_on_whole_small_table(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op12(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    few = {r["doc_id"] for r in docs if len((r["text"] or "").split()) < 800}
    assert [r for r in got if r[0] in few] == sorted(digest(*r) for r in docs if r["doc_id"] in few) and len(got) == len(docs)
