"""Hard negatives against a search of all pairs, and id files against plain encoding."""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callward.llm import idfiles, negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int"


# --- hard negatives ----------------------------------------------------------------------


def mined(rows, every=50, positives=5, k=3):
    """Every pair scored; rows of (id, label, vector)."""
    taken = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = (label, [int(np.floor(256 * float(x))) for x in v])
        taken[i] = min(taken.get(i, own), own)
    out = []
    for a, (label, v) in taken.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, (m, w) in taken.items() if i != a and len(w) == len(v))
        for score, i, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [(-s, j) for s, j, m in scored if m != label and 50 * -score <= 100 * -s <= 95 * -score][:k]
            out += [(a, i, rank, j, -score, s) for rank, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def test_intervals_hold_the_scores():
    rng = np.random.default_rng(5)
    for dim in (1, 7, 64, 100, 200):
        x = np.concatenate((rng.integers(-300, 300, (60, dim)), np.zeros((2, dim), int), np.full((2, dim), 1 << 20), np.eye(2, dim, dtype=int)))
        def block(bits, x=x):
            codes, sizes = negatives.cascade(x, bits)
            return negatives.Block.of(pd.DataFrame({"id": range(len(x)), "label": 0, "v": [r.astype("<i4").tobytes() for r in x],
                                                    "codes": [c.tobytes() for c in codes], "sizes": [s.tobytes() for s in sizes]}), bits)

        anchors, members = block(negatives.ANCHOR_BITS), block(negatives.MEMBER_BITS)
        guess, off = anchors.intervals(members, slice(0, len(x)))
        exact = x @ x.T
        assert (np.abs(guess - exact) <= off).all()
        size = np.sqrt((x.astype(float) ** 2).sum(1))[:60]
        if dim >= 64:  # narrow enough to leave pairs out
            assert (off[:60, :60] / np.outer(size, size)).mean() < 0.2


@pytest.mark.parametrize("cell", [negatives.CELL, 40])
def test_mine_equals_all_pairs(spark, cell):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(700):
        v = (centres[i % 6] + rng.normal(size=24) * 0.8) * rng.choice([0.1, 1, 3])
        rows.append((i, int(rng.choice([1] * 5 + [0, 2, 3])), v.astype(np.float32).tolist()))
    rows[100] = (100, 2, [0.0] * 24)
    for i in range(300, 360):  # copies: ties
        rows[i] = (i, 1 + i % 2, rows[50][2])
    df = spark.createDataFrame([(i, v, m) for i, m, v in rows], VECTORS).repartition(5)
    got = negatives.mine(negatives.rows(df), F.col("id") % 50 == 0, cell=cell)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)


def test_odd_vectors(spark):
    one = [1.0, 0.5]
    rows = [(0, 1, one), (50, 1, one), (1, 1, one), (2, 2, [0.7, 0.5]), (3, 2, [0.7, 0.5]), (3, 2, [0.7, 0.5]), (4, 3, [0.6, float("nan")]),
            (5, 3, [0.6, None]), (6, 3, None), (8, None, one), (None, 2, one), (9, 2, [0.7, 0.5, 0.1]), (10, 2, []), (11, 1, []), (100, 1, []), (12, 2, [float("inf"), 1.0]),
            (13, 2, [0.0, 0.0]), (150, 4, [0.0, 0.0]), (14, 4, [0.0, 0.0]), (15, 4, [-1.0, -1.0]), (200, 5, [-1.0, 0.0]), (16, 5, one), (17, 2, [3e30, 1.0]), (2, 2, [0.9, 0.1])]
    df = spark.createDataFrame([(i, v, m) for i, m, v in rows], VECTORS).withColumn("dim", F.lit("x")).withColumn("v", F.lit(1)).withColumn("id", F.lit(7))
    got = sorted(tuple(r) for r in negatives.mine(negatives.rows(df), F.col("id") % 50 == 0).collect())
    assert got == mined([r for r in rows if r[0] != 17]) and got
    empty = negatives.mine(negatives.rows(df.limit(0)), F.col("id") % 50 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# --- id files ----------------------------------------------------------------------------

WORDS = [" ", "  ", "\n", "\n\n\n", "\t", "\r\n", "a", "b'll", "don't", "'s", "'", " x", "é", "ß", "×", "1", "23", "..", ",", " ", "　", "日本",
         "<|endoftext|>", "<|", "\x1c", "\x0b", "\x85", "​", "_", "-", "ⅷ", "²", "̈", "🙂", "ŉ", "\x00", "The", "’", "É"]


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(idfiles.tokenizer_path())


def plain(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(WORDS), max_size=12).map("".join), st.text(max_size=20)), min_size=1, max_size=40))
def test_ids_are_those_of_the_tokenizer(texts):
    code = idfiles.encoder(idfiles.tokenizer_path())
    if any("\ud800" <= c <= "\udfff" for t in texts if t for c in t):
        return
    ids, ends = code.encode(pa.array(texts, pa.string()), 2)
    want = [plain(t) + [2] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want
    assert np.array_equal(code.count(pa.array(texts, pa.string()), 2), np.bincount(np.concatenate(want), minlength=len(code.bytes)))


def test_forgetting_keeps_the_ids(monkeypatch):
    code = idfiles.Encoder(idfiles.tokenizer_path())
    monkeypatch.setattr(idfiles.Encoder, "KEPT", 20)
    texts = [f"word{k % 37} and number{k % 11}, again" for k in range(90)]
    for k in range(0, 90, 5):
        ids, _ = code.encode(pa.array(texts[k:k + 5]), 2)
        assert ids.tolist() == [i for t in texts[k:k + 5] for i in [*plain(t), 2]]


@pytest.mark.parametrize(("n", "kinds"), [(1, 1), (5, 3), (511, 40), (512 * 256, 9), (512 * 256 + 1, 50_000), (idfiles.BLOCK + 7, 300), (9 * idfiles.BLOCK, 2)])
def test_blocks_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype("<u4") * 3
    own, counts = np.unique(ids, return_counts=True)
    table = idfiles.Table.unpack(idfiles.Table.of(own, counts).pack())
    assert int(table.frequency.sum()) == 1 << idfiles.SCALE and table.frequency.min() > 0
    blocks = idfiles.encode_blocks(ids, table)
    assert len(blocks) == -(-n // idfiles.BLOCK)
    raw = b"".join(blocks)
    assert np.array_equal(np.concatenate(list(idfiles.decode_blocks(memoryview(raw), len(blocks), table))), ids)
    p = counts / n
    if n > idfiles.BLOCK:  # near the entropy, but for the states at the checkpoints
        assert len(raw) < n * (-(p * np.log2(p)).sum() / 8) * 1.02 + len(blocks) * (idfiles.BLOCK // idfiles.LANES // idfiles.CHECK + 1) * 8 * (idfiles.LANES + 20)


def test_any_block_decodes_alone_and_damage_is_found():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.5, 2 * idfiles.BLOCK + 99) % 5000).astype("<u4")
    table = idfiles.Table.of(*np.unique(ids, return_counts=True))
    for k, block in enumerate(idfiles.encode_blocks(ids, table)):
        alone = list(idfiles.decode_blocks(memoryview(block), 1, table))
        assert np.array_equal(alone[0], ids[k * idfiles.BLOCK:(k + 1) * idfiles.BLOCK])
    hurt = bytearray(block)
    hurt[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(idfiles.decode_blocks(memoryview(bytes(hurt)), 1, table))
    frame = idfiles.encode_frame([3, None], np.array([50, 49]), ids[:99], table)
    names, lengths, parts = idfiles.decode_frame(frame, table)
    assert names == [3, None] and lengths.tolist() == [50, 49] and np.array_equal(np.concatenate(list(parts)), ids[:99])
    other = idfiles.Table.of(np.array([1, 2]), np.array([3, 4]))
    with pytest.raises(ValueError, match="another table"):
        idfiles.decode_frame(frame, other)
    with pytest.raises(ValueError, match="index"):
        idfiles.decode_frame(frame[:struct.calcsize(idfiles.FRAME)] + b"?" + frame[struct.calcsize(idfiles.FRAME) + 1:], table)


def expected(rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain(text), 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_archive_of_odd_rows(spark):
    rows = [(7, None), (3, ""), (-5, "below zero"), (None, "no id"), (2**40, "far"), (12, "long " * 40_000), (13, "x" * 100_000)]
    rows += [(k, f"text {k} of <|endoftext|> and more") for k in range(20, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("h", F.lit("z")).repartition(6)
    folder = idfiles.scratch(spark, "ids")
    small = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        directory = idfiles.write(docs, folder, idfiles.tokenizer_path(), 2, frame_ids=300)
    finally:
        for k in small:
            spark.conf.unset(k)
    got = idfiles.read(directory, folder, ids=True).collect()
    assert directory.count() > 4 and directory.select("part").distinct().count() > 1
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == expected(rows)
    text = dict(rows)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == [*plain(text[r["doc_id"]]), 2] for r in got)
    same = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other"), (1, None)], "doc_id long, text string")
    out = idfiles.read(*idfiles.archive(same, idfiles.tokenizer_path(), 2)).collect()
    ends = sorted((r["start"], r["n_tokens"]) for r in out)
    assert len(out) == 4 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    nothing = idfiles.read(*idfiles.archive(docs.limit(0), idfiles.tokenizer_path(), 2))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_id_files_of_the_small_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13(spark, folder).collect()), key=lambda r: r[1]) == expected(rows)
