"""Locating quotes in the transcript they claim to come from.

Containment is settled in the JVM.  The texts of a call with few pairs meet by call, each of them
shuffled once; in longer calls pairs are found through hashes of shared character grams, which travel
with ids only, so that none produces all its pairs.  Both ways give the same rows.

Quotes that are contained nowhere are compared by similarity, filter first and verify then:
* a matching ratio at the threshold bounds the lengths, so that texts meet by length class, and the
  letters both must have in common, which are counted in the JVM;
* a piece of a quote that reaches the threshold holds the quote's middle, so that an utterance must
  contain that middle, which the grams find.
Both bounds are exact.  Only pairs that pass reach the Python measure.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from callward import vocab
from callward.functions import text as T
from callward.operators.cut import materialize

GRAMS = (1, 2, 4, 8, 16)
#: Calls with no more pairs of a quote and an utterance compare them all.
PAIRS = 65_536


def haystacks(segments: DataFrame) -> DataFrame:
    """Distinct canonical utterances per call with the first place they occur."""
    both = segments.select(
        "call_id", "seq",
        F.explode(F.array(
            F.struct(F.lit(0).alias("k"), T.quote_canon(F.col("text")).alias("hay")),
            F.struct(F.lit(1).alias("k"), T.quote_canon(F.col("text_original")).alias("hay")),
        )).alias("_h"),
    ).select("call_id", "seq", "_h.k", "_h.hay").filter("hay <> ''")
    return both.groupBy("call_id", "hay").agg(F.min(F.struct("seq", "k")).alias("at"))


def _gram_size(text: Column) -> Column:
    out = F.lit(GRAMS[0])
    for g in GRAMS[1:]:
        out = F.when(F.length(text) >= g, g).otherwise(out)
    return out


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(call_id, i, o) of texts t where the inner one occurs in the outer one, via the first gram of the inner text.

    Outer texts are cut into grams of the sizes only that inner texts of their call begin with.
    """
    size = _gram_size(F.col("t"))
    head = inner.select("call_id", F.col("id").alias("i"), F.xxhash64(F.substring("t", F.lit(1), size)).alias("g"))
    asked = inner.groupBy("call_id").agg(F.collect_set(size).alias("sizes"))  # of GRAMS
    cut = "flatten(transform(filter(sizes, n -> n <= length(t)), n -> transform(sequence(1, length(t) - n + 1), k -> xxhash64(substring(t, k, n)))))"
    grams = outer.join(asked, "call_id").select("call_id", F.col("id").alias("o"), F.explode(F.array_distinct(F.expr(cut))).alias("g"))
    pairs = head.join(grams, ["call_id", "g"]).select("call_id", "i", "o").distinct()
    texts = pairs.join(inner.select("call_id", F.col("id").alias("i"), F.col("t").alias("_i")), ["call_id", "i"]) \
        .join(outer.select("call_id", F.col("id").alias("o"), F.col("t").alias("_o")), ["call_id", "o"])
    return texts.filter(F.col("_o").contains(F.col("_i"))).select("call_id", "i", "o")


def _by_pairs(quotes: DataFrame, hays: DataFrame, at_once: int) -> DataFrame:
    """(call_id, few): whether a call has at most `at_once` pairs; calls without a pair are left out."""
    a, b = (df.groupBy("call_id").agg(F.count("*").alias(n)) for df, n in ((quotes, "a"), (hays, "b")))
    return materialize(a.join(b, "call_id").select("call_id", (F.col("a") * F.col("b") <= at_once).alias("few")), "pairs")


def _met(quotes: DataFrame, hays: DataFrame, few: DataFrame, condition: Column) -> DataFrame:
    """(call_id, i, o) of the texts a, b of calls with few pairs for which the condition holds."""
    a = quotes.join(few.filter("few").select("call_id"), "call_id", "left_semi")
    return a.alias("a").join(hays.alias("b"), "call_id").filter(condition).select(
        "call_id", F.col("a.id").alias("i"), F.col("b.id").alias("o"))


def contained(quotes: DataFrame, hays: DataFrame, at_once: int = PAIRS) -> DataFrame:
    """quotes(call_id, quote_id, needle) -> (call_id, quote_id, seq) of the first containing utterance."""
    # equal texts of a call are one text
    q = quotes.select("call_id", F.xxhash64("needle").alias("id"), F.col("needle").alias("t")).distinct()
    h = hays.select("call_id", F.xxhash64("hay").alias("id"), F.col("hay").alias("t"), F.col("at.seq").alias("seq"))
    texts = h.select("call_id", "id", "t")
    few = _by_pairs(q, texts, at_once)
    near = _met(q, texts, few, F.col("b.t").contains(F.col("a.t")) | F.col("a.t").contains(F.col("b.t")))
    many = few.filter("NOT few").select("call_id")
    long_q, long_h = q.join(many, "call_id", "left_semi"), texts.join(many, "call_id", "left_semi")
    pairs = near.unionByName(_contained(long_q, long_h)).unionByName(
        _contained(long_h, long_q).select("call_id", F.col("o").alias("i"), F.col("i").alias("o")))
    first = pairs.join(h.select("call_id", F.col("id").alias("o"), "seq"), ["call_id", "o"]).groupBy("call_id", "i").agg(F.min("seq").alias("seq"))
    return quotes.select("call_id", "quote_id", F.xxhash64("needle").alias("i")).join(first, ["call_id", "i"]) \
        .groupBy("call_id", "quote_id").agg(F.min("seq").alias("seq"))


@pandas_udf(DoubleType())
def similarity(needle: pd.Series, hay: pd.Series) -> pd.Series:
    """Matching ratio of two canonical texts, or the share of the needle found in one piece.

    Pairs whose letters alone cannot reach the threshold are not aligned.
    """
    threshold = vocab.GROUNDING_THRESHOLD
    letters: dict[str, Counter] = {}

    def score(a: str, b: str) -> float:
        ca = letters.setdefault(a, Counter(a))
        common = sum((ca & Counter(b)).values())
        ratio_cap, share_cap = 2 * common / (len(a) + len(b)), common / len(a)
        if max(ratio_cap, share_cap if len(b) > len(a) else 0.0) < threshold:
            return 0.0
        matcher = difflib.SequenceMatcher(None, a, b)
        value = matcher.ratio()
        if value < threshold and len(b) > len(a):
            size = matcher.find_longest_match(0, len(a), 0, len(b)).size
            value = max(value, size / len(a))
        return value

    return pd.Series([score(a, b) for a, b in zip(needle, hay)], dtype="float64")


def _letters(text: str) -> Column:
    """How often a text has each of its characters."""
    return F.expr(f"transform(array_distinct(split({text}, '')), c -> struct(c, length({text}) - length(replace({text}, c, '')) AS n))")


#: Characters that two texts have in common, with their number; no alignment matches more.
_SHARED = ("aggregate(a.letters, 0, (s, x) -> s + least(x.n, coalesce(try_element_at(transform(filter(b.letters, y -> y.c = x.c), y -> y.n), 1), 0)))")


def _alike(quotes: DataFrame, hays: DataFrame, t: float) -> DataFrame:
    """(call_id, i, o) of texts whose lengths and letters allow a matching ratio of t.

    With a ratio of t the longer text has at most (2 - t) / t times the length of the shorter one, so
    that length classes of that width meet their neighbours only.
    """
    width = math.log((2 - t) / t) + 1e-9
    classed = lambda df: _lettered(df).withColumn("cls", F.floor(F.log("n") / width))
    a = classed(quotes).withColumn("cls", F.explode(F.array(*(F.col("cls") + k for k in (-1, 0, 1)))))
    pairs = a.alias("a").join(classed(hays).alias("b"), ["call_id", "cls"])
    lengths, letters = _bounds(t)
    return pairs.filter(lengths).filter(letters).select("call_id", F.col("a.id").alias("i"), F.col("b.id").alias("o"))


def _lettered(texts: DataFrame, *kept: str) -> DataFrame:
    return texts.select("call_id", "id", *kept, F.length("t").alias("n"), _letters("t").alias("letters"))


def _bounds(t: float) -> tuple[str, str]:
    """Whether lengths, and letters, of texts a and b allow a matching ratio of t."""
    return f"2D * least(a.n, b.n) / (a.n + b.n) >= {t - 1e-9}D", f"2D * {_SHARED} / (a.n + b.n) >= {t - 1e-9}D"


def _middle(text: str, t: float) -> Column:
    """What every piece of a share t of a text holds."""
    least = F.ceil(F.length(text) * (t - 1e-9)).cast("int")
    return F.substring(text, F.length(text) - least + 1, 2 * least - F.length(text))


def _pieced(quotes: DataFrame, hays: DataFrame, t: float) -> DataFrame:
    """(call_id, i, o) of quotes whose middle, which every piece of a share t holds, occurs in an utterance."""
    return _contained(quotes.select("call_id", "id", _middle("t", t).alias("t")), hays)


def _near(quotes: DataFrame, hays: DataFrame, few: DataFrame, t: float) -> DataFrame:
    """What `_alike` and `_pieced` give, in calls with few pairs."""
    lengths, letters = _bounds(t)
    held = F.col("b.t").contains(F.col("a.middle"))
    return _met(_lettered(quotes.withColumn("middle", _middle("t", t)), "middle"), _lettered(hays, "t"), few,
                held | (F.expr(lengths) & F.expr(letters)))


def fuzzy(residue: DataFrame, hays: DataFrame, at_once: int = PAIRS) -> DataFrame:
    """Best similar utterance at or above the threshold for quotes contained nowhere.

    residue(call_id, quote_id, needle); hays from `haystacks`.  Equal texts of a call are compared once.
    """
    t = vocab.GROUNDING_THRESHOLD
    q = residue.select("call_id", F.xxhash64("needle").alias("id"), F.col("needle").alias("t")).distinct()
    h = hays.select("call_id", F.xxhash64("hay").alias("id"), F.col("hay").alias("t"), F.col("at.seq").alias("seq"))
    texts = h.select("call_id", "id", "t")
    few = _by_pairs(q, texts, at_once)
    many = few.filter("NOT few").select("call_id")
    long_q, long_h = q.join(many, "call_id", "left_semi"), texts.join(many, "call_id", "left_semi")
    pairs = _alike(long_q, long_h, t).unionByName(_pieced(long_q, long_h, t)).distinct().unionByName(_near(q, texts, few, t))
    scored = pairs.join(q.select("call_id", F.col("id").alias("i"), F.col("t").alias("needle")), ["call_id", "i"]) \
        .join(h.select("call_id", F.col("id").alias("o"), F.col("t").alias("hay"), "seq"), ["call_id", "o"]) \
        .withColumn("score", similarity("needle", "hay")).filter(F.col("score") >= t)
    best = scored.groupBy("call_id", "i").agg(F.max(F.struct("score", (-F.col("seq")).alias("neg"))).alias("b"))
    return residue.select("call_id", "quote_id", F.xxhash64("needle").alias("i")).join(best, ["call_id", "i"]).select(
        "call_id", "quote_id", (-F.col("b.neg")).alias("seq"), F.col("b.score").alias("score"))


def locate(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """quotes(call_id, quote_id, evidence) -> seq and score, null seq when not found.

    Canonical texts and what containment finds are computed once; later steps read them several times.
    """
    q = materialize(quotes.select("call_id", "quote_id", T.quote_canon(F.col("evidence")).alias("needle")).filter("needle <> ''"), "quotes")
    hays = materialize(haystacks(segments.join(quotes.select("call_id").distinct(), "call_id", "left_semi")), "utterances")
    found = materialize(contained(q, hays).withColumns({"score": F.lit(1.0), "by": F.lit("containment")}), "contained")
    residue = q.join(found, ["call_id", "quote_id"], "left_anti")
    return found.unionByName(fuzzy(residue, hays).withColumn("by", F.lit("similarity")))


def ground(events: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach events(call_id, quote_id, evidence, category, ...) to segments.

    Returns the kept events, with time and speaker taken from the matched
    segment, and the dropped ones with the reason.
    """
    at = materialize(locate(events, segments).select(
        "call_id", "quote_id", F.col("seq").alias("segment_index"), F.round("score", 3).alias("grounding_score"), F.col("by").alias("grounded_by")), "grounded")
    where = segments.select(
        "call_id", F.col("seq").alias("segment_index"), F.col("speaker").alias("_speaker"),
        F.col("start").alias("_start"))
    kept = (
        events.drop("segment_index", "grounding_score", "grounded_by").filter(T.strip(F.col("evidence")) != "")
        .join(at, ["call_id", "quote_id"]).join(where, ["call_id", "segment_index"])
        .withColumns({"speaker": F.col("_speaker"), "start": F.col("_start"),
                      "sec": T.whole_seconds(F.col("_start"))})
        .drop("_speaker", "_start")
    )
    dropped = events.join(kept.select("call_id", "quote_id"), ["call_id", "quote_id"], "left_anti").withColumn(
        "dropped",
        F.when(T.strip(F.coalesce("evidence", F.lit(""))) == "", F.concat("category", F.lit(": empty evidence")))
        .otherwise(F.concat("category", F.lit(": evidence not found in transcript: "),
                            F.substring("evidence", 1, 60))),
    )
    return kept, dropped
