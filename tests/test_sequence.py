"""Sequence rules against a plain fold over the clauses of random calls."""

import random

from callward import vocab as v
from callward.operators import sequence
from callward.vocab import bits

CONCEPTS = ("TARGET_OTP", "TARGET_CODE_GENERIC", "TARGET_CODE_WORD", "TARGET_CARD_FULL", "TARGET_PASSWORD",
            "NEVER_ASKS", "PROBLEM_LOAN", "PROBLEM_BLOCKED", "URGENCY")


def make(seed, n_calls=60, n=25):
    rnd, rows = random.Random(seed), []
    for call in range(n_calls):
        for pos in range(n):
            names = [c for c in CONCEPTS if rnd.random() < 0.12]
            rows.append((call, pos, pos, rnd.choice(["CALLER", "CALLER", "VICTIM", "UNKNOWN"]), bits(*names),
                         rnd.choice(v.ACTS), rnd.random() < 0.1, rnd.random() < 0.15, rnd.random() < 0.05))
    return rows


def fold(rows):
    out, state, last = [], None, None
    for call, _, pos, speaker, mask, act, p_otp, p_cred, p_never in rows:
        if call != last:
            state, last = {"vp": 0, "cp": 0, "an": False, "dm": False}, call
        has = lambda *c: bool(mask & bits(*c))
        before = dict(state)
        problems = mask & bits(*v.PROBLEM_CONCEPTS)
        active = False
        if speaker == "CALLER":
            asks, forbids, states = act == "REQUEST", act == "PROHIBITION", act == "STATEMENT"
            scope = has(*v.CREDENTIAL_TARGETS) or p_cred or p_never
            if not (has(*v.OFFICIAL_CONCEPTS) or (forbids and scope and not state["dm"])):
                active, word = True, has("TARGET_CODE_WORD")
                otp = (has("TARGET_OTP") or (p_otp and asks)) and not word
                generic = has("TARGET_CODE_GENERIC") and not word
                secret = has("TARGET_CARD_FULL", "TARGET_PASSWORD")
                if (asks and (otp or generic or secret)) or (states and secret and before["cp"]):
                    state["dm"] = True
                if otp and not asks:
                    state["an"] = True
                state["cp"] |= problems & ~state["vp"]
        elif speaker == "VICTIM":
            state["vp"] |= problems
        out.append((call, pos, bool(before["cp"]), before["dm"], before["an"], active))
    return out


def test_marks_equal_a_fold(spark):
    schema = ("call_id long, clause_ix int, pos long, speaker string, mask long, act string, "
              "prior_otp boolean, prior_cred boolean, prior_never boolean")
    for seed in (1, 2, 3):
        rows = make(seed)
        sig = sequence.signals(spark.createDataFrame(rows, schema))
        got = sequence.in_context(sig, sequence.context_marks(sig)).select(
            "call_id", "pos", "problem_known", "demanded", "announced", "active")
        got = {tuple(r)[:2]: tuple(r) for r in got.collect()}
        want = {r[:2]: r for r in fold(rows)}
        assert got and all(want[k] == r for k, r in got.items())


def test_running_in_blocks_equals_a_plain_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from callward.operators.prefix import blocks_of, running

    rnd = random.Random(5)
    rows = [(k, i, rnd.choice([None, rnd.randint(0, 9)])) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, x int")
    for inclusive in (False, True):
        w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        got = running(df, ["k"], ["i"], blocks_of(F.col("i"), 7), {
            "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "n": ("count", F.lit(1)),
            "l": ("last_known", F.col("x")), "p": ("last", F.col("x")), "b": ("bit_or", F.col("x").cast("long"))}, inclusive)
        want = df.select(
            "k", "i", "x", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"), F.max("x").over(w).alias("m"),
            F.count("*").over(w).alias("n"), F.last("x", True).over(w).alias("l"),
            (F.col("x") if inclusive else F.lag("x").over(Window.partitionBy("k").orderBy("i"))).alias("p"),
            F.coalesce(F.bit_or(F.col("x").cast("long")).over(w), F.lit(0)).alias("b"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rules_find_patterns_once(spark, tmp_path, capsys):
    """The context reads the signals several times; no pattern may be sought again in any of them."""
    from checks import score_checks

    rows = [(c, t, "user" if t % 2 else "assistant", "that thing. of the und in the on to. reti the at.") for c in range(3) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    context = score_checks.context(spark, str(tmp_path))
    context.explain()
    assert "RLIKE" not in capsys.readouterr().out
    assert context.count() > 0
