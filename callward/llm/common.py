"""Helpers of the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def squeezed(docs: DataFrame, limit: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, packed): texts compressed before they travel; nulls are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit):
                raw = [zlib.compress(t, 1) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "packed"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("binary").alias("text")) \
        .mapInArrow(run, "doc_id long, packed binary")


def opened(packed: pa.Array) -> pa.Array:
    return pa.array([zlib.decompress(x).decode("utf-8", "replace") for x in packed.to_pylist()], pa.string())


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """(word codes of all texts, where each text's codes begin and the last end, distinct words).

    Words are what stands between ASCII white space; nulls have none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    codes, distinct = flat.indices.to_numpy(), flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    offsets -= offsets[0]
    if "" in distinct:  # white space at an end, or nothing else
        kept = codes != distinct.index("")
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        codes = codes[kept]
    return codes, offsets, distinct


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
