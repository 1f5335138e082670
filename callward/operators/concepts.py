"""Clauses with their concept set and speech act.

A concept set is one BIGINT, so a clause row stays small and set tests are bit
tests.  Everything up to the exploded clause row is a narrow projection: no
shuffle is needed to know what earlier clauses of the same utterance contained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callward import vocab
from callward.functions import text as T
from callward.params import Lexicon
from callward.vocab import bit, bits


def has(mask: Column, *concepts: str) -> Column:
    return mask.bitwiseAND(F.lit(bits(*concepts)).cast("bigint")) != 0


def sql_has(column: str, *concepts: str) -> str:
    """The same test as SQL text, for conditions written as SQL."""
    return f"({column} & {bits(*concepts)}L) <> 0"


def mask_sql(padded: str, lexicon: Lexicon) -> str:
    """Concept set of one clause: every concept whose pattern occurs, then overlaps resolved.

    A one-time code hides the generic code and, in the fixed wording, the password;
    a full card number hides the partial one.
    """
    found = " | ".join(
        f"IF({test}, {bit(c)}L, 0L)"
        for c in vocab.CONCEPTS if (test := lexicon.test_sql(c, padded))
    ) or "0L"
    return resolved_sql(found, padded, lexicon.otp_password_phrase)


def resolved_sql(found: str, padded: str, otp_password_phrase: str) -> str:
    """A concept set without what another concept of the clause hides."""
    otp = sql_has("m", "TARGET_OTP")
    hidden = (
        f"IF({otp}, {bit('TARGET_CODE_GENERIC')}L, 0L)"
        f" | IF({sql_has('m', 'TARGET_CARD_FULL')}, {bit('TARGET_CARD_PARTIAL')}L, 0L)"
        f" | IF({otp} AND contains({padded}, '{otp_password_phrase}'), {bit('TARGET_PASSWORD')}L, 0L)"
    )
    return f"transform(array({found}), m -> m & ~({hidden}))[0]"


def position(seq: Column, clause_ix: Column) -> Column:
    """One sortable number for (utterance, clause)."""
    return F.shiftleft(seq.cast("bigint"), 32) + clause_ix


def clauses(segments: DataFrame, lexicon: Lexicon, markers: T.ActMarkers = T.ActMarkers(),
            conjunctions: tuple[str, ...] = vocab.CONJUNCTIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """segments(call_id, seq, speaker, start, text) -> one row per clause, with the columns of `keep`.

    `prior_*` tell whether an earlier clause of the utterance named a one-time
    code, any credential, or said that nobody asks for one.  An utterance without
    words keeps one empty clause.
    """
    carried = [c for c in ("end", "confidence", "call_direction", *keep) if c in segments.columns]
    parts = T.split_clauses(F.col("text"), conjunctions)
    base = segments.select(
        "call_id", "seq", "speaker", "start", *carried,
        F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(""))).alias("_p"),
    )
    base = base.withColumn("_h", F.transform("_p", lambda p: T.pad(T.canon(p))))
    base = base.withColumns({
        "_m": F.expr(f"transform(_h, h -> {mask_sql('h', lexicon)})"),
        "_a": F.expr(f"zip_with(_h, _p, (h, p) -> {T.act_sql('h', 'p', markers)})"),
    })

    def first(*concepts: str) -> Column:
        return F.expr(f"array_position(transform(_m, m -> {sql_has('m', *concepts)}), true)")

    base = base.withColumns({
        "_otp": first("TARGET_OTP"),
        "_cred": first(*vocab.CREDENTIAL_TARGETS),
        "_never": first("NEVER_ASKS"),
    })
    rows = base.select(
        "call_id", "seq", "speaker", "start", *carried, "_otp", "_cred", "_never",
        F.posexplode(F.arrays_zip("_p", "_h", "_m", "_a")).alias("clause_ix", "_c"),
    )

    def earlier(column: str) -> Column:
        return (F.col(column) > 0) & (F.col(column) <= F.col("clause_ix"))

    return rows.select(
        "call_id", "seq", "clause_ix", position(F.col("seq"), F.col("clause_ix")).alias("pos"),
        "speaker", "start", *carried, F.col("_c._p").alias("evidence"), F.col("_c._h").alias("padded"),
        F.col("_c._m").alias("mask"), F.col("_c._a").alias("act"),
        earlier("_otp").alias("prior_otp"), earlier("_cred").alias("prior_cred"),
        earlier("_never").alias("prior_never"),
    )


def matched_stems(clause_rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per (clause, concept) with the first stem of the list that matched."""
    hits = []
    for concept, group in lexicon.stems.items():
        arms = " ".join(f"WHEN padded RLIKE ' {pattern}' THEN '{name}'" for name, pattern in group)
        hits.append(f"IF({sql_has('mask', concept)}, named_struct('concept', '{concept}', 'stem', CASE {arms} END), NULL)")
    return clause_rows.select(
        "call_id", "seq", "clause_ix", F.expr(f"inline(array_compact(array({', '.join(hits)})))"))


def concept_names(mask: str = "mask") -> Column:
    """Set as an array of names, in vocabulary order."""
    return F.expr("array_compact(array(" + ", ".join(
        f"IF({sql_has(mask, c)}, '{c}', NULL)" for c in vocab.CONCEPTS) + "))")
