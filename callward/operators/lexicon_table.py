"""Concepts from a lexicon table of any size.

`concepts.clauses` compiles a small lexicon into one pattern per concept.  Here the lexicon stays a
table (concept, stem, ord): every word of a clause gives the hash of itself and of its prefixes of the
lengths that stems begin with, stems give the hash of their first token, and both meet in an equi
join.  What follows the first token is compared in the joined row.  Spark may broadcast a small lexicon by its
measured size and splits hot words of a large one (skew join).

The rules are those of the patterns: tokens of four letters or more, and the last token of a phrase,
match as word prefixes, shorter ones and those of exact concepts as whole words.  Null or empty stems
match nothing; rows that repeat a stem count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.functions import text as T
from callward.operators import concepts
from callward.params import Lexicon
from callward.vocab import bit

CLAUSE = ["call_id", "seq", "clause_ix"]


def stems(lexicon: DataFrame, exact: tuple[str, ...] = tuple(vocab.EXACT_CONCEPTS)) -> DataFrame:
    """(concept, stem, ord, tokens, opens, key): `opens` tells the tokens that match as prefixes."""
    rows = lexicon.select("concept", "stem", F.col("ord").cast("long").alias("ord"), T.tokens(F.col("stem")).alias("tokens")) \
        .filter(F.col("concept").isin(*vocab.CONCEPTS) & (F.size("tokens") > 0))
    plain = F.col("concept").isin(*exact)
    opens = F.transform("tokens", lambda t, i: ~plain & ((F.length(t) >= 4) | ((i > 0) & (i == F.size("tokens") - 1))))
    rows = rows.withColumn("opens", opens)
    return rows.withColumn("key", F.xxhash64(F.col("opens")[0], F.col("tokens")[0]))


def matches(clause_rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(call_id, seq, clause_ix, concept, stem): the first stem in list order of every concept found, overlaps not resolved.

    Two numbers and the lengths of first tokens are fetched; there are no more of them than letters in the longest word.
    """
    table = stems(lexicon)
    size = table.agg(F.max(F.size("tokens")).alias("n"), F.collect_set(F.when(F.col("opens")[0], F.length(F.col("tokens")[0]))).alias("l")).first()
    words = clause_rows.select(*CLAUSE, F.split(F.trim("padded"), " ").alias("w")).select(*CLAUSE, "w", F.posexplode("w").alias("p", "word"))
    prefixes = [F.when(F.length("word") >= n, F.xxhash64(F.lit(True), F.substring("word", 1, n))) for n in sorted(size["l"])]
    keyed = words.filter("word <> ''").select(
        *CLAUSE, F.slice("w", F.col("p") + 1, F.lit(size["n"] or 1)).alias("said"),
        F.explode(F.array_compact(F.array(F.xxhash64(F.lit(False), F.col("word")), *prefixes))).alias("key"))
    follows = F.expr("size(said) >= size(tokens) AND forall(transform(tokens, (t, i) -> IF(opens[i], startswith(said[i], t), said[i] = t)), x -> x)")
    found = keyed.join(table, "key").filter(follows)
    return found.groupBy(*CLAUSE, "concept").agg(F.min(F.struct("ord", "stem")).alias("s")).select(*CLAUSE, "concept", "s.stem")


def _bits(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{c}' THEN {bit(c)}L" for c in vocab.CONCEPTS) + " ELSE 0L END"


def clauses(segments: DataFrame, lexicon: DataFrame, markers: T.ActMarkers = T.ActMarkers(),
            conjunctions: tuple[str, ...] = vocab.CONJUNCTIONS, otp_password_phrase: str = vocab.OTP_PASSWORD_PHRASE,
            found: DataFrame | None = None) -> DataFrame:
    """The clause rows of `concepts.clauses`, with concept sets from the table; `found` takes `matches` made before."""
    rows = concepts.clauses(segments, Lexicon((), otp_password_phrase), markers, conjunctions)
    found = matches(rows, lexicon) if found is None else found
    raw = found.groupBy(*CLAUSE).agg(F.expr(f"bit_or({_bits('concept')})").alias("_m"))
    kept = rows.drop("mask", "prior_otp", "prior_cred", "prior_never").join(raw, CLAUSE, "left").withColumn(
        "mask", F.expr(concepts.resolved_sql("coalesce(_m, 0L)", "padded", otp_password_phrase))).drop("_m")

    def first(*names: str) -> Column:
        return F.min(F.when(concepts.has(F.col("mask"), *names), F.col("clause_ix")))

    said = kept.filter("mask <> 0").groupBy("call_id", "seq").agg(
        first("TARGET_OTP").alias("_otp"), first(*vocab.CREDENTIAL_TARGETS).alias("_cred"), first("NEVER_ASKS").alias("_never"))
    out = kept.join(said, ["call_id", "seq"], "left")
    for flag in ("otp", "cred", "never"):
        out = out.withColumn(f"prior_{flag}", F.coalesce(F.col(f"_{flag}") < F.col("clause_ix"), F.lit(False)))
    return out.select(*rows.columns)


def matched_stems(clause_rows: DataFrame, found: DataFrame) -> DataFrame:
    """`found` without the concepts that an overlap hides in `clause_rows`."""
    own = found.join(clause_rows.select(*CLAUSE, "mask"), CLAUSE)
    return own.filter(F.expr(f"(mask & {_bits('concept')}) <> 0")).select(*CLAUSE, "concept", "stem")
