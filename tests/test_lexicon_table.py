"""A lexicon kept as a table against the same lexicon as patterns."""

import random

from pyspark.sql import functions as F

from callward import vocab
from callward.operators import concepts, lexicon_table
from callward.params import Lexicon

SEGMENT = "call_id long, seq long, speaker string, start double, text string"
FLAGS = ("call_id", "seq", "clause_ix", "pos", "mask", "act", "prior_otp", "prior_cred", "prior_never", "evidence")


def _rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_same_sets_flags_and_stems_as_patterns(spark):
    rng = random.Random(3)
    letters = "abcdeя"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    stems = {}
    for concept in rng.sample(list(vocab.CONCEPTS), 30) + ["TARGET_OTP", "TARGET_CODE_GENERIC", "TARGET_PASSWORD", "TARGET_CARD_FULL", "TARGET_CARD_PARTIAL", "NEVER_ASKS"]:
        stems[concept] = tuple(" ".join(rng.choice(words)[:rng.randint(1, 6)] for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(4))
    stems["TARGET_OTP"] += ("Ab, C!", "", "  ", words[0])
    lexicon = Lexicon.of(stems, otp_password_phrase="ab")
    said = [(k // 7, k % 7, "CALLER", 1.0 * k, ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 4)))) for k in range(400)]
    said += [(900, 0, "CALLER", 0.0, ""), (900, 1, "CALLER", 0.0, None), (900, 2, "CALLER", 0.0, "?!")]
    segs = spark.createDataFrame(said, SEGMENT)
    table = lexicon.to_df(spark).unionByName(lexicon.to_df(spark).limit(5)).unionByName(
        spark.createDataFrame([("TARGET_OTP", None, 99), ("NO_CONCEPT", words[1], 1)], "concept string, stem string, ord int"))
    want = concepts.clauses(segs, lexicon)
    plain = concepts.clauses(segs, Lexicon((), "ab"))
    found = lexicon_table.matches(plain, table)
    got = lexicon_table.clauses(segs, table, otp_password_phrase="ab", found=found)
    assert _rows(got, FLAGS) == _rows(want, FLAGS)
    assert got.columns == want.columns
    columns = ("call_id", "seq", "clause_ix", "concept", "stem")
    assert _rows(lexicon_table.matched_stems(got, found), columns) == _rows(concepts.matched_stems(want, lexicon), columns)
    assert found.count() > 1000


def test_a_million_stems(spark):
    """Most stems are never said; those that are give what the small lexicon gives."""
    many = spark.range(1_000_000).select(
        F.element_at(F.array(*map(F.lit, vocab.CONCEPTS)), (F.col("id") % len(vocab.CONCEPTS) + 1).cast("int")).alias("concept"),
        F.concat(F.lit("w"), F.hex(F.xxhash64("id")), F.when(F.col("id") % 3 == 0, F.concat(F.lit(" v"), F.hex("id"))).otherwise("")).alias("stem"),
        F.col("id").cast("int").alias("ord"))
    known = many.filter("ord % 9973 = 0").collect()
    rng = random.Random(1)
    said = [(k, 0, "CALLER", 0.0, " ".join(rng.choice(known).stem + rng.choice(["", "", "x"]) for _ in range(6))) for k in range(300)]
    segs = spark.createDataFrame(said, SEGMENT)
    small = Lexicon(tuple((r.concept, r.stem) for r in sorted(known, key=lambda r: (r.concept, r.ord))))
    got = lexicon_table.clauses(segs, many)
    assert _rows(got, FLAGS) == _rows(concepts.clauses(segs, small), FLAGS) and got.filter("mask <> 0").count() > 250


def test_empty_tables(spark):
    segs = spark.createDataFrame([(1, 0, "CALLER", 0.0, "a b")], SEGMENT)
    none = spark.createDataFrame([], "concept string, stem string, ord int")
    assert [r["mask"] for r in lexicon_table.clauses(segs, none).collect()] == [0]
    assert lexicon_table.clauses(segs.limit(0), none).count() == 0


def test_plain_stems_need_no_pattern(spark):
    lexicon = Lexicon.of({"THREAT": ("arrest", "on", "you will lose it"), "URGENCY": ("act now", "arrest the man"), "FEAR": tuple(f"word{k}" for k in range(40))})
    assert "RLIKE" not in Lexicon.of({"THREAT": ("arrest", "on", "my man")}).test_sql("THREAT", "h")
    assert lexicon.test_sql("FEAR", "h").count("RLIKE") == 1
    texts = ["", "arrested", "an arrest", "rearrest", "on", "only", "act nowadays", "act no", "react now", "you willing lose items", "you will lose", "arresting the manor",
             "arrest a man", "word399", "sword3"]
    df = spark.createDataFrame([(f" {t} ",) for t in texts], "h string")
    for concept in lexicon.stems:
        got = df.selectExpr("h", f"{lexicon.test_sql(concept, 'h')} AS got", f"h RLIKE '{lexicon.pattern(concept)}' AS want").collect()
        assert [r.got for r in got] == [r.want for r in got] and any(r.got for r in got)
