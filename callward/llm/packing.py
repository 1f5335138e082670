"""Vector best-fit packing of documents into training sequences.

Two steps.  `pieces` encodes whole documents, ends each with an end id and cuts only those
that exceed a sequence.  `pack` deals the pieces to groups of about `group_rows` and fills
sequences group by group, largest piece first.  A sequence has three residual capacities:
tokens, documents and attention cost (the sum of squared piece lengths).  Among the open
sequences that satisfy every constraint the one with the smallest weighted norm of what would
remain is taken, or with rule="dot" the one with the largest weighted dot product of piece and
residual.  A group leaves less than one sequence unfilled on average, so that dealing costs
about one sequence per group; pieces and groups are rows of numbers, texts do not move.

Nulls count as empty texts: one piece with the end id alone.  Repeated rows are packed each for
itself.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callward.llm.common import ranges, slices, split_words
from callward.operators.cut import materialize

CAPACITY = 2048
GROUP_ROWS = 8192
SLICE = 4 << 20  # bytes of text that are encoded at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Fixed values of the word vocabulary: how it splits a lower-case text into words.  Within the
# characters of PLAIN they don't depend on normalization.
PLAIN = r"^[\t-\r\x20-\x7eÀ-ÿ]*$"
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Encoder:
    """Ids of whole texts.

    No word of the vocabulary spans white space.  Texts of plain characters are split there and
    each distinct chunk of a slice is looked up once; what a worker hasn't met is encoded word by
    word.  Other texts, and those that name a special token, go to the tokenizer whole.
    """

    KEPT = 400_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        """Encode words in one call; a word's ids end where a token ends a word."""
        ids = self.whole(" ".join(new))
        ends = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        if len(ends) == len(new) + 1:
            self.words.update(zip(new, (raw[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))
        else:
            self.words.update((w, self.whole(w).tobytes()) for w in new)

    def _chunks(self, distinct: list[str]) -> list[bytes]:
        for known in (self.chunks, self.words):
            if len(known) > self.KEPT:
                known.clear()
        found = list(map(self.chunks.get, distinct))
        lacking = [k for k, v in enumerate(found) if v is None]
        split = [WORDS.findall(distinct[k]) for k in lacking]
        if new := list(set().union(*split).difference(self.words)):
            self._learn(new)
        get = self.words.__getitem__
        for k, parts in zip(lacking, split, strict=True):
            found[k] = self.chunks[distinct[k]] = b"".join(map(get, parts))
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; where each text's ids begin and the last end)."""
        texts = pc.fill_null(texts, "")
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|")))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        codes, offsets, distinct = split_words(pc.utf8_lower(pc.if_else(plain, texts, "")))
        found = [*self._chunks(distinct), np.array([end_id], "<u4").tobytes()]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        codes = np.insert(codes, offsets[1:], len(distinct))
        many = sizes[codes]
        ids = flat[np.repeat(begins[codes], many) + ranges(many)]
        ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], offsets[1:] + np.arange(1, len(offsets))))]
        if len(odd):
            parts = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            for k in odd.tolist():
                parts[k] = np.append(self.whole(texts[k].as_py()), np.array(end_id, "<u4"))
            ids, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: its place in the document's ids, and the checksum of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ends = code.encode(part.column("text"), end_id)
                own = np.diff(ends)
                many = -(-own // capacity)
                doc, piece = np.repeat(np.arange(len(own)), many), ranges(many)
                start = piece * capacity
                length = np.minimum(capacity, own[doc] - start)
                at = (ends[doc] + start).tolist()
                sums = [zlib.crc32(ids[a:a + n]) for a, n in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                     pa.array(length), pa.array(sums, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fit(lengths: np.ndarray, capacity: int, max_documents: int, max_attention: float,
        weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, largest first."""
    limits = np.array([capacity, max_documents, max_attention], float)
    w = np.array(weights)
    left = np.empty((len(lengths), 3))
    number = np.empty(len(lengths), np.int64)
    n = opened = 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1.0, float(size) * size])
        here = left[:n]
        fits = np.flatnonzero((here >= need).all(axis=1))
        if len(fits):
            rest = here[fits] / limits
            asked = need / limits
            good = (rest * asked * w).sum(axis=1) if rule == "dot" else -(((rest - asked) ** 2) * w).sum(axis=1)
            k = int(fits[np.argmax(good)])
        else:
            k, left[n], number[n] = n, limits, opened
            n, opened = n + 1, opened + 1
        sequence[i], offset[i] = number[k], capacity - int(left[k, 0])
        left[k] -= need
        if left[k, 0] < least or left[k, 1] < 1:  # full: the last open one takes its place
            n -= 1
            left[k], number[k] = left[n], number[n]
    return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, max_documents: int | None = None,
         max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
         rule: str = "norm", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces.

    Without limits of their own, documents and attention cost are bounded by what a full
    sequence can hold, so that only the tokens bind.
    """
    documents, attention = max_documents or capacity, max_attention or float(capacity) ** 2
    kept = materialize(parts, "pieces")
    groups = max(1, -(-kept.count() // group_rows))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = fit(rows["length"].to_numpy(), capacity, documents, attention, weights, rule)
        return rows.drop(columns="__group").assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)

    dealt = kept.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """The packed ids: one row per sequence with its pieces' ids in order of offset.

    Documents are encoded anew where they lie and only their ids travel.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for part in slices(batch):
                ids, ends = code.encode(part.column("text"), end_id)
                raw = [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    raw = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).mapInArrow(run, "doc_id long, raw binary")
    own = packed.join(raw, "doc_id").select(
        "sequence_id", "offset", F.expr("substring(raw, int(start * 4 + 1), int(length * 4))").alias("part"))
    return own.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.part))").alias("ids"))
