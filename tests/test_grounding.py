"""Similar quotes against comparing every quote with every utterance."""

import difflib
import random

from pyspark.sql import functions as F

from callward import vocab
from callward.operators import grounding


def score(a, b):
    matcher = difflib.SequenceMatcher(None, a, b)
    value = matcher.ratio()
    if value < vocab.GROUNDING_THRESHOLD and len(b) > len(a):
        value = max(value, matcher.find_longest_match(0, len(a), 0, len(b)).size / len(a))
    return value


def _changed(rng, text):
    """A quote of a text: cut, with letters swapped, words dropped or put in."""
    words = text.split()
    a = rng.randint(0, max(0, len(words) - 2))
    words = words[a:a + rng.randint(2, 12)]
    out = list(" ".join(w for w in words if rng.random() > 0.1) or "x")
    for _ in range(rng.randint(0, max(1, len(out) // 5))):
        out[rng.randrange(len(out))] = rng.choice("abcdezя ")
    return " ".join("".join(out).split()) or "x"


def test_similarity_equals_all_pairs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefя") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    hays, quotes = [], []
    for call in range(6):
        for seq in range(rng.choice([0, 1, 5, 40])):
            hays.append((call, seq, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))))
    hays += [(3, 900, "x"), (3, 901, "ab"), (2, 902, "long " * 300)]
    said = [h for h in hays]
    for k in range(260):
        call, _, text = rng.choice(said)
        quotes.append((call if rng.random() < 0.9 else 77, k, _changed(rng, text)))
    quotes += [(3, 1000 + k, x) for k, x in enumerate(["x", "y", "ab", "ba", quotes[0][2], quotes[0][2]])]
    spoken = spark.createDataFrame(hays, "call_id long, seq long, text string").withColumn("text_original", F.col("text"))
    got = {(r.call_id, r.quote_id): (r.seq, round(r.score, 9)) for r in grounding.fuzzy(
        spark.createDataFrame(quotes, "call_id long, quote_id long, needle string"), grounding.haystacks(spoken)).collect()}
    first = {}
    for call, seq, text in hays:
        key = (call, " ".join(text.split()))
        first[key] = min(seq, first.get(key, seq))
    want = {}
    for call, k, needle in quotes:
        best = max(((score(needle, hay), -seq) for (c, hay), seq in first.items() if c == call), default=(0, 0))
        if best[0] >= vocab.GROUNDING_THRESHOLD:
            want[call, k] = (-best[1], round(best[0], 9))
    assert got == want and len(want) > 100


def test_pairs_are_few_and_no_join_goes_by_call_alone(spark, capsys):
    rng = random.Random(2)
    hays = [(1, k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "zeta", "q" * 9]) for _ in range(rng.randint(1, 40)))) for k in range(300)]
    texts = spark.createDataFrame([(1, k, t) for _, k, t in hays], "call_id long, id long, t string")
    needles = spark.createDataFrame([(1, k, "zz " + "ypsilon " * (k % 30 + 1)) for k in range(300)], "call_id long, id long, t string")
    t = vocab.GROUNDING_THRESHOLD
    pairs = grounding._alike(needles, texts, t).unionByName(grounding._pieced(needles, texts, t))
    assert pairs.count() < 300 * 300 / 100
    pairs.explain()
    plan = capsys.readouterr().out
    assert "cls" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nothing_to_compare(spark):
    spoken = spark.createDataFrame([], "call_id long, seq long, text string").withColumn("text_original", F.col("text"))
    assert grounding.fuzzy(spark.createDataFrame([(1, 1, "a b c")], "call_id long, quote_id long, needle string"), grounding.haystacks(spoken)).count() == 0


def test_calls_with_few_pairs_and_long_ones_ground_alike(spark, capsys):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    hays = [(c, k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 15)))) for c in range(5) for k in range(12)]
    quotes = [(c, k, _changed(rng, text) if k % 2 else text[3:-2].strip() or "a") for c, k, text in hays]
    quotes += [(c, 100 + k, text + " and more") for c, k, text in hays[::5]] + [(9, 1, "a")]
    spoken = spark.createDataFrame(hays, "call_id long, seq long, text string").withColumn("text_original", F.col("text"))
    q, h = spark.createDataFrame(quotes, "call_id long, quote_id long, needle string"), grounding.haystacks(spoken)
    for find in (grounding.contained, grounding.fuzzy):
        # all calls by their pairs, none, and those below a bound
        got = [sorted(tuple(r) for r in find(q, h, n).collect()) for n in (10**9, 0, 200)]
        assert got[0] == got[1] == got[2] and len(got[0]) > 20


def test_texts_of_calls_with_few_pairs_are_not_cut_into_grams(spark):
    text = " ".join(f"word{k}" for k in range(400))
    texts = spark.createDataFrame([(c, c, text) for c in range(20)], "call_id long, id long, t string")
    few = grounding._by_pairs(texts, texts, grounding.PAIRS)
    assert few.filter("few").count() == 20 and few.filter("NOT few").count() == 0
    assert grounding._met(texts, texts, few, F.col("b.t").contains(F.col("a.t"))).count() == 20
