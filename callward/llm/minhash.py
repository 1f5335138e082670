"""Near-duplicate groups by b-bit MinHash.

Sketch: of HASHES minima over a document's distinct five-word shingles only the low four bits are
kept, packed sixteen to a 64-bit word.  Bands of ROWS full minima give the candidates; a pair of
similarity 0.75 misses all bands with a probability of about 2e-5.  A candidate's similarity is
estimated by bit counts, corrected for chance agreement of four bits, and pairs more than MARGIN
below the threshold are dropped; the rest is confirmed on the full shingle sets.

Groups are never expanded into all pairs:
1. Equal shingle sets become one representative (the smallest id) by a partial aggregate.
2. In each bucket of a band every member is compared with two leaders.  Confirmed links give
   components.
3. Where a bucket still holds several components beside its leaders, members outside the largest
   one are compared with the others in blocks of BLOCK x BLOCK signatures.  What comes out is not pairs
   of documents but which component a member may belong to.
4. Such a member meets the texts of that component in cells of CELL x CELL and is confirmed on full
   sets, best estimate first, until a link is found.  So no link is lost: two documents that share a
   band are either compared or known to be in one component.

Lower-casing is of A-Z, words stand between ASCII white space.  Documents without words, null texts
and null ids are linked with nothing; such a document is its own component (null for a null id, and
kept).  Texts of fewer than five words have their whole sequence as one shingle.  Repeated rows are
copies of each other; rows of one id count as one document.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward.llm.common import opened, slices, split_words, squeezed
from callward.operators.cut import materialize

WORDS = 5
BANDS, ROWS = 56, 6
HASHES = BANDS * ROWS
SHARE = (75, 100)
MARGIN = 0.1
LEAST = SHARE[0] / SHARE[1] - MARGIN
BLOCK = 2048
CELL = 512
SLICE = 2 << 20  # bytes of text that are cut into shingles at once
MIX = np.uint64(0x9E3779B97F4A7C15)
NIBBLES = np.uint64(0x1111111111111111)

_random = np.random.default_rng(20)
FACTOR = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    codes, offsets, distinct = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    if not len(codes):
        return [np.zeros(0, np.uint64)] * len(texts)
    word = pd.util.hash_array(np.array(distinct, object), categorize=False)[codes]
    padded = np.concatenate((word, np.zeros(WORDS, np.uint64)))
    h = np.zeros(len(word), np.uint64)
    for j in range(WORDS):
        h = (h ^ (h >> np.uint64(29))) * MIX + padded[j:j + len(word)]
    h ^= h >> np.uint64(32)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(h[a:b - WORDS + 1]))
        elif b > a:
            whole = hashlib.blake2b(word[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a set, 32 bits each."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1024):
        x = (shingles[at:at + 1024] >> np.uint64(32)).astype(np.uint32)[:, None] * FACTOR
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        np.minimum(low, x.min(0), out=low)
    return low


def _packed(low: np.ndarray) -> np.ndarray:
    """The low four bits of the minima, sixteen to a word."""
    bits = (low & np.uint32(15)).astype(np.uint64).reshape(-1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)


def _band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ (key >> np.uint64(31))) * MIX + low.reshape(BANDS, ROWS)[:, j]
    return (key ^ (key >> np.uint64(32))) * MIX


SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>, bands array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"))
                digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
                lows = [minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.array([None if x is None else _packed(x).view(np.int64) for x in lows], pa.list_(pa.int64())),
                    pa.array([None if x is None else _band_keys(x).view(np.int64) for x in lows], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def estimated(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: agreeing nibbles, less those that agree by chance."""
    def apart(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(int(NIBBLES))))

    differ = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, x: s + x)
    return ((1 - differ / F.lit(float(HASHES))) - 1 / 16) / (1 - 1 / 16)


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a ^ b
    z |= z >> np.uint64(1)
    z |= z >> np.uint64(2)
    differ = np.bitwise_count(z & NIBBLES).sum(-1, dtype=np.int64)
    return ((1 - differ / HASHES) - 1 / 16) / (1 - 1 / 16)


def _common(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * share[1] >= (len(a) + len(b) - both) * share[0]


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the wanted documents, materialized; rows of one id give one text.

    The ids are written first, so that Spark knows their size when it chooses how they meet the texts:
    while they can be broadcast, only wanted texts travel.
    """
    wanted = squeezed(docs).join(materialize(ids, "wanted"), "doc_id", "left_semi")
    return materialize(wanted.groupBy("doc_id").agg(F.min("packed").alias("packed")), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tb", 1 << 20):
                firsts = part.column("ta").dictionary_encode()
                of_a = shingle_sets(opened(firsts.dictionary))
                good = [_common(of_a[k], s, share) for k, s in
                        zip(firsts.indices.to_pylist(), shingle_sets(opened(part.column("tb"))), strict=True)]
                yield part.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("ta")), "a") \
        .join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over the links (a, b).

    Labels move along links and then along themselves, so that chains shorten by halves.
    """
    ways = materialize(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct(), "ways")
    labels = materialize(ways.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = ways.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("other")), "v") \
            .groupBy("u").agg(F.min("other").alias("other"))
        moved = labels.join(near, labels["node"] == near["u"]).select("node", F.least("comp", "other").alias("next"), F.col("comp").alias("old"))
        # a label is itself a node: where it points in the last round is reachable too
        step = moved.join(labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond")), "next", "left") \
            .select("node", F.least("next", F.coalesce("beyond", "next")).alias("comp"), "old")
        step = materialize(step, "labels")
        labels = step.select("node", "comp")
        if step.where("comp <> old").limit(1).count() == 0:
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the links between components are followed."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("comp").alias("c"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    moved = components(links.where("a <> b"))
    old = labels.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left") \
        .select("node", F.coalesce("to", "comp").alias("comp"))
    return materialize(old.unionByName(moved.join(labels, "node", "left_anti")), "labels")


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of cells sorted by g: which component a member may be linked to, by the estimates."""
    def cell(g: pd.DataFrame) -> pd.DataFrame:
        asks = g["ask"].to_numpy()
        own, other = g[asks], g[~asks]
        ids, comps = [], []
        if len(own) and len(other):
            sig, theirs = np.stack(other["sig"].to_numpy()).view(np.uint64), other["comp"].to_numpy()
            for s, rep, comp in zip(own["sig"], own["rep"], own["comp"], strict=True):
                near = (_estimates(np.asarray(s).view(np.uint64), sig) >= LEAST) & (theirs != comp)
                found = np.unique(theirs[near]).tolist()
                ids += [rep] * len(found)
                comps += found
        return pd.DataFrame({"rep": np.array(ids, np.int64), "comp": np.array(comps, np.int64)})

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows["g"] == rows["g"].iloc[-1]).to_numpy()
        held, rows = rows[last], rows[~last]
        found = [cell(x) for _, x in rows.groupby("g", sort=False)]
        if found:
            yield pd.concat(found).drop_duplicates()
    if held is not None:
        yield cell(held).drop_duplicates()


def _across(buckets: DataFrame, sigs: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, comp): members outside their bucket's largest component, and the other components of the
    bucket that hold a signature near theirs."""
    rows = buckets.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left") \
        .withColumn("comp", F.coalesce("comp", "rep"))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1") \
        .select("key", F.col("top.comp").alias("top"), F.ceil(F.col("n") / BLOCK).alias("across"),
                F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("down"))
    own = rows.join(mixed, "key").join(sigs, "rep")
    asks = own.where("comp <> top").select(
        "key", "rep", "comp", "sig", F.lit(True).alias("ask"), _slot("rep", F.col("down"), 1).alias("y"),
        F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"))
    told = own.select(
        "key", "rep", "comp", "sig", F.lit(False).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"),
        _slot("rep", F.col("across"), 2).alias("x"))
    dealt = asks.unionByName(told).withColumn("g", F.xxhash64("key", "x", "y"))
    return dealt.select("g", "rep", "comp", "sig", "ask").repartition("g").sortWithinPartitions("g") \
        .mapInPandas(_asked, "rep long, comp long").distinct()


def _slot(column: str, n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), n)


def _joined(asked: DataFrame, sigs: DataFrame, labels: DataFrame, docs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) of the asked members to members of the asked components.

    Members meet in cells of CELL x CELL texts; a member's candidates are confirmed on the full sets,
    best estimate first, until one is linked: a second link to the same component adds nothing.
    """
    nodes = labels.select("node", "comp").unionByName(
        asked.select(F.col("comp").alias("node"), "comp").distinct().join(labels.select("node"), "node", "left_anti").select("node", "comp"))
    theirs = nodes.join(asked.select("comp").distinct(), "comp", "left_semi").select("comp", F.col("node").alias("rep"))
    sizes = theirs.groupBy("comp").agg(F.count("*").alias("n")).join(asked.groupBy("comp").agg(F.count("*").alias("m")), "comp") \
        .select("comp", F.ceil(F.col("n") / CELL).alias("across"), F.ceil(F.col("m") / CELL).alias("down"))
    texts = _texts(docs, asked.select("rep").union(theirs.select("rep")).distinct().withColumnRenamed("rep", "doc_id")) \
        .withColumnRenamed("doc_id", "rep")
    asks = asked.join(sizes, "comp").select(
        "comp", "rep", F.lit(True).alias("ask"), _slot("rep", F.col("down"), 3).alias("y"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"))
    told = theirs.join(sizes, "comp").select(
        "comp", "rep", F.lit(False).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"), _slot("rep", F.col("across"), 4).alias("x"))
    dealt = asks.unionByName(told).join(sigs, "rep").join(texts, "rep")

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["ask"].to_numpy()
        own, other = rows[asks], rows[~asks]
        out = []
        if len(own) and len(other):
            sig, ids = np.stack(other["sig"].to_numpy()).view(np.uint64), other["rep"].to_numpy()
            sets = shingle_sets(opened(pa.array(other["packed"], pa.binary())))
            for s, rep, mine in zip(own["sig"], own["rep"], shingle_sets(opened(pa.array(own["packed"], pa.binary()))), strict=True):
                est = _estimates(np.asarray(s).view(np.uint64), sig)
                for k in np.argsort(-est, kind="stable"):
                    if est[k] < LEAST:
                        break
                    if _common(mine, sets[k], share):
                        out.append((min(rep, ids[k]), max(rep, ids[k])))
                        break
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("comp", "x", "y").applyInPandas(lambda rows: cell(rows), "a long, b long")


def groups(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    known = materialize(sketches(docs), "sketches")
    live = known.where("n_shingles > 0 and doc_id is not null")
    members = live.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    first = live.join(members.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2"], "left_semi") \
        .dropDuplicates(["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("rep"), "sig", "bands")
    first = materialize(first, "representatives")
    sigs = first.select("rep", "sig")
    # the band is hashed into its key
    every = first.select("rep", F.explode("bands").alias("key"))
    # most keys are met once: keys alone are counted, and only rows of shared ones travel with their ids, the same way at every size
    shared = materialize(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    banded = materialize(every.join(shared.hint("merge"), "key", "left_semi"), "banded")
    leaders = banded.groupBy("key").agg(F.min("rep").alias("one"), F.min_by("rep", F.xxhash64("rep")).alias("two"))
    buckets = materialize(banded.join(leaders, "key"), "buckets")
    pairs = buckets.select("rep", F.explode(F.array("one", "two")).alias("lead")).where("rep <> lead") \
        .select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    near = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a") \
        .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b") \
        .where(estimated(F.col("sa"), F.col("sb")) >= LEAST).select("a", "b").distinct()
    labels = components(confirmed(materialize(near, "near"), docs, share))
    # the leaders have met every member
    others = buckets.where("rep <> one and rep <> two").select("key", "rep")
    asked = materialize(_across(others, sigs, labels), "asked")
    if not asked.isEmpty():
        labels = _merged(labels, materialize(_joined(asked, sigs, labels, docs, share), "joined"))
    comp = labels.select(F.col("node").alias("rep"), "comp")
    # written first: the join with all rows is then one that Spark can split where a set has very many copies
    of_set = materialize(members.join(comp, "rep", "left").select("d1", "d2", F.coalesce("comp", "rep").alias("comp")), "sets")
    out = known.select("doc_id", "n_shingles", "d1", "d2").join(of_set, ["d1", "d2"], "left")
    mine = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), mine).alias("component_id")) \
        .withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def unique(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """One document of each group, with all its columns; of rows that share an id, the smallest."""
    found = materialize(groups(docs, share), "groups").where("doc_id is not null")
    copies = found.where("not kept").select("doc_id")
    again = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = docs.join(copies.union(again).distinct(), "doc_id", "left_anti").select(*docs.columns)
    rest = [c for c in docs.columns if c != "doc_id"]
    merged = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("__row")) \
        .select(*[F.col("doc_id") if c == "doc_id" else F.col("__row")[c].alias(c) for c in docs.columns])
    return once.unionByName(merged)
