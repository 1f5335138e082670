"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

`write` encodes whole texts with a byte-level tokenizer, ends each document with an end id and writes
all ids in ascending order of doc_id.  The order is made by a range partitioning of the texts; each
task writes one file of frames.  A frame holds whole documents: their ids and lengths, then the token
ids in blocks of BLOCK.  All blocks of an archive share one table of frequencies, counted over all
documents; apart from that each decodes on its own.

Within a block LANES states take the ids in turn, so that one numpy step codes an id of each lane,
and of several blocks at once.  Every CHECK steps the block notes the states and its place among the
coded words: a checkpoint, from which decoding can begin.  `read` decodes all stretches between the
checkpoints of several blocks side by side.  Checksums cover the table, the frame's index, the coded
body and the decoded ids of each block; a difference is an error.

`write` returns the directory, one row per frame: file, its number among the files, offset, size,
and how many documents and ids the frame holds and stand before it in the file.  `read` turns frames
into documents; where documents stand among all ids follows from the sizes of the files before.

Frequencies are scaled to sum to 2^SCALE with at least one for each id that occurs.  The table is bounded
by the vocabulary, the only thing that goes to every task.  Memory is bounded by a slice of texts, a
batch of blocks, or the longest document.

Null texts count as empty: the end id alone.  Rows that repeat a doc_id stand next to each other and are
told apart by a hash of their text; equal rows are each a document.  Null doc_ids come first.  An empty
table gives an empty directory.  Columns other than doc_id and text are not read.  Files are written and
read through pyarrow's file systems by URI, under names of the task attempt's own; only files of
committed attempts are in the directory.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callward.llm.common import ranges, slices
from callward.llm.warc import store
from callward.operators.cut import materialize, scratch

SCALE = 20          # frequencies sum to 2 to this power
LOW = 1 << 31       # states stay at or above; below, a 32-bit word is read
LANES = 512
CHECK = 256         # steps from one checkpoint to the next
BLOCK = 1024 * LANES
TOGETHER = 8        # blocks coded side by side
MAGIC, VERSION = b"IDRN", 1
FRAME = "<4sHHIIQIII"  # magic, version, lanes, documents, blocks, ids, crc of table and index, index bytes
HEAD = "<IIIIII"      # ids, steps, words, checkpoints, crc of the ids, crc of the body
DIRECTORY = "file string, part int, offset long, size long, n_docs long, n_ids long, before long"


# --- token ids ---------------------------------------------------------------------------

# White space of other scripts and controls whose class isn't plain; texts with them are encoded whole.
ODD = r"[\x00-\x08\x0E-\x1F\x7F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}]|<\|"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER, DIGIT, MARK, OTHER = 1, 2, 3, 0
KIND = np.array([LETTER if chr(b).isalpha() and b < 128 else DIGIT if 48 <= b < 58 else MARK if 32 < b < 127 else OTHER for b in range(256)], np.uint8)


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where parts of texts begin that are encoded alike wherever they stand; `data` are UTF-8 bytes.

    A pre-token never goes on from a visible character to white space, nor from a letter, a digit or
    a mark to another of the three, but for an apostrophe and what follows it.
    """
    space, kind = SPACE[data], KIND[data]
    if len(data) > 1:  # À to ÿ are letters but for two signs
        kind[1:][(data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)] = LETTER
    first = np.empty(len(data), bool)
    first[:1] = True
    before, now = kind[:-1], kind[1:]
    first[1:] = (space[1:] & ~space[:-1]) | (before != now) & (before != OTHER) & (now != OTHER) & (data[:-1] != 39)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return np.flatnonzero(first)


class Encoder:
    """Ids of whole texts by a byte-level vocabulary.

    Texts are split into parts that have the same ids wherever they stand.  Each distinct part of a
    slice is looked up once; those that a worker hasn't met are encoded together.
    """

    KEPT = 500_000
    LEARN = 1 << 10

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.known: dict[bytes, bytes] = {}
        self.past: dict[bytes, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[bytes]) -> None:
        """Encode parts in a row and cut the ids at their ends; a line end goes before those without white space."""
        row = [x if SPACE[x[0]] else b"\n" + x for x in new]
        ids = self.whole(b"".join(row).decode())
        ends = [0, *np.cumsum(self.bytes[ids]).tolist()]
        place = dict(zip(ends, range(0, 4 * len(ends), 4), strict=True))
        raw, until = ids.tobytes(), 0
        for x, y in zip(new, row, strict=True):
            until += len(y)
            self.known[x] = raw[place[until - len(x)]:place[until]]  # a KeyError would be a token that goes on beyond its part

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each part; parts met long ago are forgotten."""
        if len(self.known) > self.KEPT:
            self.known, self.past = {}, self.known
        known, past = self.known, self.past
        row: list[bytes] = []
        size = 0
        for x in distinct:
            if x in known:
                continue
            if x in past:
                known[x] = past[x]
            elif SPACE[x[-1]]:  # white space at the end of a text
                known[x] = self.whole(x.decode()).tobytes()
            else:
                row.append(x)
                size += len(x)
                if size > self.LEARN:
                    self._learn(row)
                    row, size = [], 0
        if row:
            self._learn(row)
        return list(map(known.__getitem__, distinct))

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(part of each place, how many parts end with each text, ids of the parts, texts that are left out)."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        if len(odd):
            plain = np.ones(len(texts), bool)
            plain[odd] = False
            texts = pc.if_else(pa.array(plain), texts, "")
        flat = texts.cast(pa.large_string()).cast(pa.large_binary())
        bounds = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]] if len(flat) else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0] if len(flat) else np.zeros(1, np.int64)
        starts = cuts(data, bounds)
        edges = np.concatenate((starts, [len(data)]))
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        found = self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        return parts.indices.to_numpy(), np.searchsorted(starts, bounds[1:]), found, odd

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; where each text's ids begin and the last end)."""
        texts = pc.fill_null(texts, "")
        codes, after, found, odd = self._split(texts)
        found.append(np.array([end_id], "<u4").tobytes())
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        codes = np.insert(codes, after, len(found) - 1)
        many = sizes[codes]
        ids = pool[np.repeat(begins[codes], many) + ranges(many)]
        ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], after + np.arange(1, len(after) + 1)))]
        if len(odd):
            own = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            for k in odd.tolist():
                own[k] = np.append(self.whole(texts[k].as_py()), np.array(end_id, "<u4"))
            ids, ends = np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))
        return ids, ends

    def count(self, texts: pa.Array, end_id: int) -> np.ndarray:
        """How often each id occurs in the texts and their ends, without writing the ids down."""
        texts = pc.fill_null(texts, "")
        codes, _, found, odd = self._split(texts)
        times = np.bincount(codes, minlength=len(found))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        total = np.zeros(len(self.bytes), np.int64)
        np.add.at(total, np.frombuffer(b"".join(found), "<u4"), np.repeat(times, sizes))
        for k in odd.tolist():
            np.add.at(total, self.whole(texts[k].as_py()), 1)
        total[end_id] += len(texts)
        return total


def encoder(path: str) -> Encoder:
    """The worker's own encoder.

    Functions travel to the workers by value and bring their variables along, so that what is to last
    from task to task is kept with the interpreter.
    """
    kept = sys.__dict__.setdefault("_callward_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- frequency table ---------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """Frequencies of the ids that occur, in order of id; they sum to 2^SCALE."""

    ids: np.ndarray
    frequency: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        total, slots = int(counts.sum()), 1 << SCALE
        if len(ids) > slots:
            raise ValueError(f"{len(ids)} different ids; a table of {slots} slots can't hold them")
        share = [1 + int(c) * (slots - len(ids)) // total for c in counts]
        over = slots - sum(share)
        for k in np.argsort(-counts, kind="stable")[:over].tolist():
            share[k] += 1
        return cls(ids.astype("<u4"), np.array(share, "<u4"))

    @cached_property
    def crc(self) -> int:
        return zlib.crc32(self.ids.tobytes() + self.frequency.tobytes())

    @cached_property
    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """(frequency, sum of those before) as states are reckoned."""
        f = self.frequency.astype(np.uint64)
        return f, np.cumsum(f) - f

    @cached_property
    def symbols(self) -> np.ndarray:
        """The place in the table of every slot."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.frequency)

    @cached_property
    def place(self) -> np.ndarray:
        """The place in the table of every id."""
        out = np.zeros(int(self.ids.max()) + 1, np.int32)
        out[self.ids] = np.arange(len(self.ids))
        return out

    def pack(self) -> bytes:
        return struct.pack("<II", len(self.ids), self.crc) + self.ids.tobytes() + self.frequency.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Table:
        n, crc = struct.unpack_from("<II", raw)
        out = cls(np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, "<u4", n, 8 + 4 * n))
        if out.crc != crc:
            raise ValueError("frequency table: checksum differs")
        return out


# --- blocks ------------------------------------------------------------------------------


def _push(symbols: np.ndarray, table: Table) -> tuple[list[np.ndarray], list[dict[int, np.ndarray]], np.ndarray]:
    """Code blocks of (step, lane) symbols side by side, from the last step to the first.

    Returns each block's words in the order of reading, the states at each checkpoint, and how many
    words each block reads in each step.
    """
    frequency, before = table.wide
    blocks, steps, lanes = symbols.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    top, down, half = np.uint64(63 - SCALE), np.uint64(32), np.uint64(SCALE)
    words, whose = [], []
    read = np.zeros((blocks, steps), np.int64)
    states: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        if (t + 1) % CHECK == 0 and t + 1 < steps:
            states[t + 1] = x.copy()
        f = frequency[symbols[:, t]]
        full = x >= f << top
        counts = full.sum(1)
        read[:, t] = counts
        words.append(x[full].astype("<u4"))
        whose.append(np.repeat(np.arange(blocks, dtype=np.uint8), counts))
        np.right_shift(x, down, out=x, where=full)
        times = x // f
        x = (times << half) + (x - times * f) + before[symbols[:, t]]
    states[0] = x
    flat, owner = np.concatenate(words[::-1]), np.concatenate(whose[::-1])
    by = np.argsort(owner, kind="stable")
    cuts = np.cumsum(read.sum(1))[:-1]
    return np.split(flat[by], cuts), [{t: s[k] for t, s in states.items()} for k in range(blocks)], read


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """The ids as blocks of BLOCK, the last of what is left."""
    out: list[bytes] = []
    full = len(ids) // BLOCK * BLOCK
    groups = [ids[a:min(a + TOGETHER * BLOCK, full)] for a in range(0, full, TOGETHER * BLOCK)]
    for group in [*groups, ids[full:]]:
        if not len(group):
            continue
        whole = len(group) % BLOCK == 0
        each = BLOCK if whole else -(-len(group) // LANES) * LANES
        symbols = table.place[group]
        if not whole:  # the last step is filled up
            symbols = np.concatenate((symbols, np.full(each - len(group), symbols[-1], np.int32)))
        words, states, read = _push(symbols.reshape(-1, each // LANES, LANES), table)
        passed = np.cumsum(read, axis=1) - read
        for k, (own, checks) in enumerate(zip(words, states, strict=True)):
            part = group[k * each:(k + 1) * each]
            body = b"".join(struct.pack("<II", t, int(passed[k, t])) + checks[t].astype("<u8").tobytes() for t in sorted(checks))
            body += own.tobytes()
            out.append(struct.pack(HEAD, len(part), each // LANES, len(own), len(checks), zlib.crc32(part.tobytes()), zlib.crc32(body)) + body)
    return out


def _pull(states: np.ndarray, places: np.ndarray, words: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """The (stretch, step, lane) symbols of stretches that begin with these states, at these places of the words."""
    frequency, before = table.wide
    symbols, mask, down, half = table.symbols, np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE)
    x, places = states.copy(), places.copy()
    out = np.empty((len(x), steps, x.shape[1]), np.int32)
    for t in range(steps):
        slot = x & mask
        s = symbols[slot]
        out[:, t] = s
        x = frequency[s] * (x >> half) + slot - before[s]
        lacking = x < LOW
        counts = lacking.sum(1)
        more = words[np.repeat(places, counts) + ranges(counts)]
        x[lacking] = x[lacking] << down | more
        places += counts
    return out


def decode_blocks(raw: memoryview, blocks: int, table: Table) -> Iterator[np.ndarray]:
    """The ids of the blocks, some at a time and in order."""
    at = 0
    while blocks:
        group, words, used = [], [], 0
        for _ in range(min(blocks, TOGETHER)):
            n, steps, n_words, checks, ids_crc, body_crc = struct.unpack_from(HEAD, raw, at)
            size = checks * (8 + 8 * LANES) + 4 * n_words
            body = raw[at + struct.calcsize(HEAD):at + struct.calcsize(HEAD) + size]
            if zlib.crc32(body) != body_crc:
                raise ValueError("block: checksum of the body differs")
            for k in range(checks):
                t, passed = struct.unpack_from("<II", body, k * (8 + 8 * LANES))
                state = np.frombuffer(body, "<u8", LANES, k * (8 + 8 * LANES) + 8)
                group.append((min(CHECK, steps - t), state, used + passed, n if not k else 0, ids_crc))
            words.append(np.frombuffer(body, "<u4", n_words, size - 4 * n_words))
            used += n_words
            at += struct.calcsize(HEAD) + size
            blocks -= 1
        flat = np.concatenate(words).astype(np.uint64)
        done: list[np.ndarray] = [None] * len(group)  # type: ignore[list-item]
        for steps in {g[0] for g in group}:
            own = [k for k, g in enumerate(group) if g[0] == steps]
            symbols = _pull(np.stack([group[k][1] for k in own]), np.array([group[k][2] for k in own]), flat, steps, table)
            for k, s in zip(own, symbols, strict=True):
                done[k] = s.reshape(-1)
        heads = [k for k, g in enumerate(group) if g[3]]
        for k, end in zip(heads, [*heads[1:], len(group)], strict=True):
            ids = table.ids[np.concatenate(done[k:end])[:group[k][3]]]
            if zlib.crc32(ids.tobytes()) != group[k][4]:
                raise ValueError("block: checksum of the ids differs")
            yield ids


# --- frames ------------------------------------------------------------------------------


def encode_frame(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    named = np.array([d is not None for d in docs], np.uint8)
    index = zlib.compress(np.array([d or 0 for d in docs], "<i8").tobytes() + lengths.astype("<u8").tobytes() + named.tobytes(), 1)
    blocks = encode_blocks(ids, table)
    return struct.pack(FRAME, MAGIC, VERSION, LANES, len(docs), len(blocks), len(ids), table.crc, zlib.crc32(index), len(index)) + index + b"".join(blocks)


def decode_frame(raw: bytes, table: Table) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """(documents, lengths, ids in parts)."""
    magic, version, lanes, n, blocks, _, table_crc, index_crc, size = struct.unpack_from(FRAME, raw)
    if (magic, version, lanes, table_crc) != (MAGIC, VERSION, LANES, table.crc):
        raise ValueError("frame: not of this format, or of another table")
    index = raw[struct.calcsize(FRAME):struct.calcsize(FRAME) + size]
    if zlib.crc32(index) != index_crc:
        raise ValueError("frame: checksum of the index differs")
    index = zlib.decompress(index)
    docs, lengths = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n, 8 * n).astype(np.int64)
    names = [d if named else None for d, named in zip(docs.tolist(), index[16 * n:], strict=True)]
    return names, lengths, decode_blocks(memoryview(raw)[struct.calcsize(FRAME) + size:], blocks, table)


# --- the archive -------------------------------------------------------------------------


def frequencies(docs: DataFrame, path: str, end_id: int) -> Table | None:
    """The table of all ids of all documents; at most one row per id of the vocabulary reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        total = np.zeros(len(code.bytes), np.int64)
        for batch in batches:
            for part in slices(batch):
                total += code.count(part.column("text"), end_id)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["id", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, n long") \
        .groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return Table.of(found["id"].to_numpy(), found["n"].to_numpy()) if len(found) else None


def write(docs: DataFrame, folder: str, path: str, end_id: int, frame_ids: int = TOGETHER * BLOCK) -> DataFrame:
    """Write table and files, and return the directory, materialized."""
    table = frequencies(docs, path, end_id)
    spark = docs.sparkSession
    if table is None:
        return spark.createDataFrame([], DIRECTORY)
    system, root = store(folder)
    with system.open_output_stream(f"{root}/table", compression=None) as out:
        out.write(table.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, out, rows, before = encoder(path), None, [], 0
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        where = f"{root}/{uuid.uuid4().hex}.ids"
        system, _ = store(folder)

        def flush() -> None:
            nonlocal before
            ids = np.concatenate(held)
            raw = encode_frame(names, np.concatenate(lengths), ids, table)
            rows.append((where, TaskContext.get().partitionId(), out.tell(), len(raw), len(names), len(ids), before))
            out.write(raw)
            before += len(ids)
            names.clear(), lengths.clear(), held.clear()

        try:
            for batch in batches:
                for part in slices(batch):
                    out = out or system.open_output_stream(where, compression=None)
                    ids, ends = code.encode(part.column("text"), end_id)
                    names += part.column("doc_id").to_pylist()
                    lengths.append(np.diff(ends))
                    held.append(ids)
                    if sum(map(len, held)) >= frame_ids:
                        flush()
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
        columns = [c.split(" ")[0] for c in DIRECTORY.split(", ")]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=columns).astype(
            {c: "int32" if c == "part" else "int64" for c in columns[1:]}), preserve_index=False)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                          F.xxhash64(F.col("text").cast("string")).alias("h")) \
        .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, DIRECTORY), "id-directory")


def read(directory: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """Per document: doc_id, start among all ids, n_tokens, ids_crc32, and with `ids` the ids as 32-bit little-endian numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        table = None
        for batch in batches:
            for frame in batch.to_pylist():
                if table is None:
                    with system.open_input_file(f"{root}/table") as source:
                        table = Table.unpack(source.read())
                with system.open_input_file(frame["file"]) as source:
                    source.seek(frame["offset"])
                    raw = source.read(frame["size"])
                names, lengths, parts = decode_frame(raw, table)
                places = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int64()), pa.array(places + frame["before"] + frame["base"]), pa.array(lengths),
                    *_documents(lengths, parts, ids)], names=[c.split(" ")[0] for c in schema.split(", ")])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    # one row per file that a task wrote
    files = directory.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toPandas()
    bases = directory.sparkSession.createDataFrame(
        pd.DataFrame({"part": files["part"].astype("int32"), "base": (files["n"].cumsum() - files["n"]).astype("int64")}), "part int, base long")
    spread = max(directory.sparkSession.sparkContext.defaultParallelism, 1)
    return directory.join(F.broadcast(bases), "part").repartition(4 * spread, "file", "offset").mapInArrow(run, schema)


def _documents(lengths: np.ndarray, parts: Iterator[np.ndarray], ids: bool) -> list[pa.Array]:
    """[checksum of each document's ids] and, if asked for, the ids."""
    sums, own = [], []
    rest = np.zeros(0, "<u4")
    for n in lengths.tolist():
        crc, kept = 0, []
        while n:
            if not len(rest):
                rest = next(parts)
            now, rest = rest[:n], rest[n:]
            n -= len(now)
            raw = now.tobytes()
            crc = zlib.crc32(raw, crc)
            if ids:
                kept.append(raw)
        sums.append(crc)
        own.append(b"".join(kept))
    if len(rest) or next(parts, None) is not None:
        raise ValueError("frame: more ids than its documents have")
    return [pa.array(sums, pa.int64())] + [pa.array(own, pa.binary())] * ids


def archive(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> tuple[DataFrame, str]:
    """(directory, folder) of the documents' ids; without a folder, in the session's shared one."""
    folder = folder or scratch(docs.sparkSession, "ids")
    return write(docs, folder, path, end_id), folder
