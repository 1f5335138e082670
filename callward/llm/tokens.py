"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens: leaves hold the characters and tokens of one
pre-token each, inner nodes the sums of their subtrees.  An edit (start, delete, insert) is located
by descending the tree; the touched leaves, the two pre-tokens before them and the text up to the
next boundary that falls together with an old one are split and encoded anew, their counts go
into the leaves of the run, and the sums above the run are updated.  Everything else keeps its
counts.

The split looks ahead by two characters at most and never back, so that from a boundary two
pre-tokens before an edit it goes as it would over the whole text, and as soon as it meets an old
boundary behind the edit the rest is as it was.

`build` gives (doc_id, n_tokens, tree) and `edit` applies lists of edits to texts with their trees;
trees are binary, kept with the document in whatever table the user writes, and an edited tree can
be edited again.  Edits of a list are applied one after the other, each to the text that the one
before left.  Places are clipped to the text; null fields count as 0, 0 and "".

Null texts count as empty: no tokens, and they can be edited.  Repeated rows are counted each for
itself.  An empty table gives an empty result.  Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callward.llm.common import slices

# Fixed value of the byte-level vocabulary: how it splits a text into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRETOKENS = regex.compile(PATTERN)
BEFORE = 2


class Counter:
    """Tokens of pre-tokens; what a worker has met is remembered up to a bound."""

    KEPT = 400_000

    def __init__(self, path: str):
        """`path`: the vocabulary as lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.asked = 0

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def counts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        self.asked += len(parts)
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) > self.KEPT:
                self.known.clear()
            for k, n in enumerate(found):
                if n is None:
                    found[k] = self.known[parts[k]] = len(self.encoding.encode_ordinary(parts[k]))
        return np.array(found, np.int32)


class Tree:
    """Sums over a power of two of leaves; level 0 has the leaves."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        size = 1 << max(0, (len(chars) - 1).bit_length())
        self.chars, self.tokens = [np.zeros(size, np.int32)], [np.zeros(size, np.int32)]
        self.chars[0][:len(chars)], self.tokens[0][:len(tokens)] = chars, tokens
        while len(self.chars[-1]) > 1:
            self.chars.append(self.chars[-1].reshape(-1, 2).sum(1, dtype=np.int32))
            self.tokens.append(self.tokens[-1].reshape(-1, 2).sum(1, dtype=np.int32))

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[-1][0])

    def find(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character, where the leaf begins); beyond the end, the last leaf."""
        leaf = begin = 0
        place = min(place, int(self.chars[-1][0]) - 1)
        for level in reversed(self.chars[:-1]):
            leaf *= 2
            if place >= begin + level[leaf]:
                begin += int(level[leaf])
                leaf += 1
        return leaf, begin

    def put(self, first: int, last: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Give leaves first..last new pre-tokens, the rest of them none, and update the sums above.

        More pre-tokens than leaves are spliced in: the sums are built anew, nothing is encoded again.
        """
        if len(chars) > last - first + 1:
            leaves = [np.concatenate((level[0][:first], new, level[0][last + 1:])) for level, new in ((self.chars, chars), (self.tokens, tokens))]
            full = leaves[0] > 0
            self.__init__(leaves[0][full], leaves[1][full])
            return
        for levels, value in ((self.chars, chars), (self.tokens, tokens)):
            levels[0][first:last + 1] = 0
            levels[0][first:first + len(value)] = value
            a, b = first, last
            for below, level in zip(levels, levels[1:], strict=False):
                a, b = a // 2, b // 2
                level[a:b + 1] = below[2 * a:2 * b + 2].reshape(-1, 2).sum(1, dtype=np.int32)

    def pack(self) -> bytes:
        return np.stack((self.chars[0], self.tokens[0])).astype("<i4").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        chars, tokens = np.frombuffer(raw, "<i4").reshape(2, -1)
        return cls(chars, tokens)


def tree_of(text: str, counter: Counter) -> Tree:
    parts = PRETOKENS.findall(text)
    return Tree(np.fromiter(map(len, parts), np.int32, len(parts)), counter.counts(parts)) if parts else Tree(np.zeros(1, np.int32), np.zeros(1, np.int32))


def apply(text: str, tree: Tree, start: int, delete: int, insert: str, counter: Counter) -> str:
    """Edit the text and its tree."""
    start = min(max(start, 0), len(text))
    delete = min(max(delete, 0), len(text) - start)
    new = text[:start] + insert + text[start + delete:]
    if not text or not new:
        tree.__dict__.update(tree_of(new, counter).__dict__)
        return new
    leaves = tree.chars[0]
    first, begin = tree.find(start)
    for _ in range(BEFORE):  # empty leaves belong to the run before them
        while first > 0:
            first -= 1
            begin -= int(leaves[first])
            if leaves[first]:
                break
    last, last_begin = tree.find(max(start + delete - 1, start, 0))
    end = last_begin + int(leaves[last])  # of the touched leaves, in the old text
    shift = len(insert) - delete
    # split on from the boundary until a new boundary meets an old one behind the edit
    tokens, at = [], begin
    while at < len(new):
        part = PRETOKENS.match(new, at).group()
        tokens.append(part)
        at += len(part)
        while end + shift < at and last + 1 < len(leaves):
            last += 1
            end += int(leaves[last])
        if at == end + shift and at >= start + len(insert):
            break
    else:
        last = len(leaves) - 1
    tree.put(first, last, np.fromiter(map(len, tokens), np.int32, len(tokens)), counter.counts(tokens))
    return new


_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def build(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the tree of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                trees = [tree_of(t or "", counter) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([t.n_tokens for t in trees], pa.int64()),
                     pa.array([t.pack() for t in trees], pa.binary())], names=["doc_id", "n_tokens", "tree"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, tree binary")


def replacing(pattern: str, by: dict[str, str], other: str) -> Callable[[str], list[dict]]:
    """A rule that replaces every match by `by[match]` or else `other`, last place first."""
    found = regex.compile(pattern)

    def rule(text: str) -> list[dict]:
        return [{"start": m.start(), "delete": m.end() - m.start(), "insert": by.get(m.group(), other)}
                for m in found.finditer(text)][::-1]

    return rule


def edit(docs: DataFrame, path: str, rule: Callable[[str], list[dict]] | None = None, texts: bool = True) -> DataFrame:
    """Apply the edits of column `edits`, a list of (start, delete, insert), or those of a rule.

    The column `tree` holds the trees of `build`; where it is absent or null, a tree is built first.
    doc_id, n_tokens before and n_tokens_after, n_edits, the pre-tokens counted anew for them, and
    with `texts` the new text and tree.
    """
    fields = "doc_id long, n_tokens long, n_tokens_after long, n_edits int, recounted long" + ", text string, tree binary" * texts
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_tokens_after", pa.int64()), ("n_edits", pa.int32()),
                        ("recounted", pa.int64())] + [("text", pa.string()), ("tree", pa.binary())] * texts)

    def row(doc: int | None, text: str, raw: bytes | None, edits: list, counter: Counter) -> dict:
        tree = Tree.unpack(raw) if raw else tree_of(text, counter)
        before, asked = tree.n_tokens, counter.asked
        for e in edits:
            text = apply(text, tree, e["start"] or 0, e["delete"] or 0, e["insert"] or "", counter)
        out = {"doc_id": doc, "n_tokens": before, "n_tokens_after": tree.n_tokens, "n_edits": len(edits), "recounted": counter.asked - asked}
        return out | ({"text": text, "tree": tree.pack()} if texts else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                rows = []
                for x in part.to_pylist():
                    text = x["text"] or ""
                    edits = [e for e in x["edits"] or [] if e is not None] if rule is None else rule(text)
                    rows.append(row(x["doc_id"], text, x["tree"], edits, counter))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kept = docs if "tree" in docs.columns else docs.withColumn("tree", F.lit(None).cast("binary"))
    if rule is not None:
        kept = kept.withColumn("edits", F.lit(None).cast("int"))
    return kept.select("doc_id", "text", "tree", "edits").mapInArrow(run, fields)
