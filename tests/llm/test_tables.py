"""Archives, nearest neighbours, the registered queries and the pipeline."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callward.llm import ann, minhash, packing, queries, warc

SMALL = "/root/testdata/sf0.01"


# --- WARC ---------------------------------------------------------------------------------


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ODD = [(1, "http://a.b.org/x?q=1", "same"), (2, "http://a.b.org/x?q=1", "same"), (3, None, None), (4, "::bad::[", ""), (5, "http://a.b.org/ü y\n", "ü\r\n\r\nz"),
       (6, "https://c.org:81/", "x" * 300_000), (None, "http://n.org/", "same"), (7, "http://a.b.org/x?q=1", "other"), (2, "http://a.b.org/x?q=1", "same")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string").withColumn("key", F.lit("k")).withColumn("file", F.lit(1)).repartition(3)
    directory, folder = warc.archive(pages)
    out = warc.read_back(directory, folder, payloads=True).collect()
    assert len(out) == len(ODD)
    by = {r["page_id"]: r for r in out}
    for page, url, html in ODD:
        r = by[page]
        assert (r["url"], r["payload_digest"], r["payload_bytes"]) == (url, digest(html), len((html or "").encode()))
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == (html or "").encode() and r["refers_to"] is None
    assert [(by[k]["record_type"], by[k]["refers_to"]) for k in (1, 2, 3, 4, None)] == [
        ("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("revisit", 2)]
    small, where = warc.archive(pages, min_revisit_bytes=5)
    assert {r["record_type"] for r in warc.read_back(small, where).collect()} == {"response"}


def test_lookup_by_index(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 9}.example.org/p{k % 50}", f"page {k}") for k in range(400)], "page_id long, url string, html string")
    folder = warc.scratch(spark, "lookup")
    directory = warc.build_index(warc.write_archives(pages, folder), folder, block_entries=7)
    asked = spark.createDataFrame([("http://h3.example.org/p3",), ("http://none.org/",), (None,)], "url string")
    got = sorted(r["page_id"] for r in warc.lookup(asked, directory, folder).collect())
    assert got == [k for k in range(400) if k % 9 == 3 and k % 50 == 3]
    assert warc.surt("https://www.a.org:81/x?y") == "org,a,www:81)/x?y"


def test_empty_archive(spark):
    directory, folder = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_back(directory, folder).count() == 0


# --- nearest neighbours ----------------------------------------------------------------------


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        s = (x * v).sum(1)
        other = np.flatnonzero(ids != i)
        order = other[np.lexsort((ids[other], -s[other]))][:k]
        out[int(i)] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_recall_against_brute_force(spark):
    rows = ann.vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    data = [(r["id"], r["v"]) for r in rows.collect()]
    got, want = answers(ann.nearest(rows, rows.where("id % 20 = 0"))), brute(data, 20)
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in got]
    assert len(got) == sum(i % 20 == 0 for i, _ in data) and np.mean(found) >= 0.9


def test_small_tables_are_searched_in_full(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=5) * 3 ** (k % 4)).tolist()) for k in range(12)] + [(50, [1.0, 0.0, 0.0, 0.0, 0.0]), (51, [1.0, 0.0, 0.0, 0.0, 0.0]), (52, [1.0, 0.0, 0.0, 0.0, 0.0])]
    odd = [(90, None), (91, [0.0] * 5), (92, [None] * 5), (93, [float("nan")] * 5), (94, [float("inf")] * 5), (95, [1.0, 2.0]), (None, [1.0] * 5), (96, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("v", F.lit("x")).repartition(3)
    x32 = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    vectors = ann.vectors(table)
    assert answers(ann.nearest(vectors, vectors, k=20)) == brute(x32, 20)
    assert answers(ann.exhaustive(vectors, vectors, 4)) == brute(x32, 4)
    none = ann.vectors(table.limit(0))
    assert ann.nearest(none, none).count() == 0


def test_a_hot_bucket_is_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 16)
    rows = [(k, [1.0, 0.001 * (k % 3), 0.0]) for k in range(300)]
    vectors = ann.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert answers(ann.nearest(vectors, vectors.where("id < 40"), k=5)) == {k: v for k, v in brute(rows, 5).items() if k < 40}


# --- queries and pipeline ----------------------------------------------------------------------


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_op4_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lambda: sorted((r["doc_id"], r["component_id"]) for r in minhash.groups(docs).collect())
    want = rows()
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "CELL", 2)
    assert rows() == want


@pytest.mark.parametrize("rows", [0, 9])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"
    same = " ".join(f"w{k}" for k in range(60))
    odd = [(1, same, None, None, None, "s", 1), (2, same, "en", "a", 3, None, None), (2, same, "en", "a", 3, None, None), (3, None, None, "a", 0, None, 1), (4, "", "", "", 0, "", 1),
           (None, "x y", "en", "a", 3, "s", 1), (5, "word " * 20_000, "en", "a", 1, "s", 1), (6, "item text of a benchmark that is copied into this document here now", "en", "a", 1, "s", 1),
           (7, "\n\n", "en", "a", 2, "s", 1)]
    docs = spark.createDataFrame(odd[:rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, odd[7][1]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    kept = sorted(r["doc_id"] or 0 for r in at.collect())
    assert kept == ([0, 1, 3, 4, 5, 7] if rows else [])
    out = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert sorted({r["doc_id"] or 0 for r in out.collect()}) == kept


def test_pipeline_equals_its_parts(spark):
    """Every kept document is packed whole, in order, and none that the stages drop."""
    out = corpus_pipeline.run(spark, SMALL)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    at = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SMALL)
    want = {r["doc_id"]: r["text"] for r in at.collect()}
    assert set(got) == set(want)
    tokenizer = packing.encoder(packing.tokenizer_path()).tokenizer
    for i, text in want.items():
        assert sum(n for *_, n in got[i]) == len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
