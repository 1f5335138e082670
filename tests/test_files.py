"""Readers, writers, text cleanup and masking."""

import json

import pytest
from pyspark.sql import functions as F

from callward.functions import masking as M
from callward.functions import text as T
from callward.operators import store
from callward.sources import readers, writers
from tests.calls import LEXICON

SEGMENT = {"speaker": "CALLER", "start": 1.0, "end": 2.0, "language": "ru", "text": "Да", "confidence": 0.5}


def test_replay_folder_skips_broken_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"call_direction": "inbound", "segments": [SEGMENT, SEGMENT]}, indent=1))
    (tmp_path / "two.json").write_text("{broken")
    calls = readers.replay_calls(spark, str(tmp_path))
    assert [r.call_id for r in calls.collect()] == ["one"]
    assert readers.turns_of(calls).count() == 2


def test_annotated_folder_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"segments": [SEGMENT], "gold": {"classification": "SAFE"}, "split": "test"}))
    (tmp_path / "b.json").write_text(json.dumps({"segments": [SEGMENT]}))
    row = readers.annotated_calls(spark, str(tmp_path)).collect()
    assert [(r.call_id, r.family, r.asr_noisy, r.split, r.slices) for r in row] == [("a", "real::a", True, "test", ["real"])]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i}", "train" if i else "test") for i in range(5)], "call_id string, split string")
    assert writers.jsonl(df, str(tmp_path / "all")) == 5
    assert readers.dataset(spark, str(tmp_path / "all")).count() == 5
    writers.by_split(df, str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split" / "split=test")).count() == 1
    with pytest.raises(Exception):
        readers.dataset(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "bad.jsonl").write_text('{"call_id": "a"}\n\n{"call_id": \n{"call_id": "b"}\n')
    lines = readers.corpus_lines(spark, str(tmp_path / "bad.jsonl")).cache()
    assert (lines.count(), lines.filter("rejected is not null").count()) == (3, 1)
    with pytest.raises(Exception):
        readers.dataset(spark, str(tmp_path / "bad.jsonl")).collect()


def test_completions_in_odd_shapes(spark):
    factor = '{"category": "OTP_REQUEST", "severity": "%s", "speaker": "CALLER"}'
    shapes = [('{"classification": "SCAM", "scam_types": "OTP_THEFT", "confidence": "0.9"}', True), ('[1, 2]', False), ("", False), (None, False),
              ('text {"classification": "SAFE"} and {more', True), ('{"classification": "SCAM"', False), ('{"confidence": 2}', False),
              ('{"risk_factors": [' + factor % "BOGUS" + ']}', False), ('{"risk_factors": [' + factor % "HIGH" + ']}', True),
              ('```json\n{"classification": "SUSPICIOUS"}\n```', True), ('{"classification": "MAYBE"}', False), ('{"explanation": "a } b"}', True)]
    out = readers.completions(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(shapes)], "i int, completion string")).collect()
    assert {r.i: r.valid for r in out} == {i: ok for i, (_, ok) in enumerate(shapes)}
    first = next(r for r in out if r.i == 0)
    assert first.scam_types == ["OTP_THEFT"] and first.confidence == 0.9


def test_reports_and_stored_table(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "eval_x.json").write_text(json.dumps({"backend": "x", "split": "test", "overall": {"json_validity": 1.0}}))
    (tmp_path / "r" / "eval_y.json").write_text("nope")
    assert [r.report for r in readers.eval_reports(spark, str(tmp_path / "r")).collect()] == ["eval_x"]
    path = str(tmp_path / "calls")
    writers.save_table(spark.range(100).selectExpr("id AS call_id", "0 AS v"), path, 4)
    load = lambda: writers.load_table(spark, path)
    writers.save_table(load().withColumn("v", F.lit(1)), path, 4)
    assert load().agg(F.sum("v"), F.count("*")).first()[:] == (100, 100)
    writers.save_table(load().filter("call_id > 1"), path, 4)
    writers.save_table(load().filter("call_id < 4"), path, 64)
    assert sorted(r.call_id for r in load().collect()) == [2, 3]
    writers.append_table(spark.range(7, 8).selectExpr("id AS call_id", "1 AS v"), path)
    assert sorted(r.call_id for r in load().collect()) == [2, 3, 7]
    # only one version is on disk, without what was removed
    assert [f.name for f in (tmp_path / "calls").iterdir() if not f.name.startswith(".")] == ["v000000000003"]
    assert spark.read.parquet(f"{path}/v000000000003").filter("call_id NOT IN (2, 3, 7)").count() == 0
    with pytest.raises(FileNotFoundError):
        writers.load_table(spark, str(tmp_path / "none"))


def test_a_save_that_fails_midway_leaves_the_old_content(spark, tmp_path):
    path = str(tmp_path / "calls")
    writers.save_table(spark.range(50).selectExpr("id AS call_id", "'old' AS v"), path, 4)
    broken = writers.load_table(spark, path).withColumn(
        "v", F.when(F.col("call_id") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        writers.save_table(broken, path, 4)
    assert {r.v for r in writers.load_table(spark, path).collect()} == {"old"}
    # files without a mark, as a driver leaves them that is lost before the switch
    writers.with_bucket(spark.range(3).selectExpr("id AS call_id", "'half' AS v")).write.mode("overwrite").parquet(f"{path}/v000000000001")
    assert writers.load_table(spark, path).count() == 50
    writers.save_table(writers.load_table(spark, path).withColumn("v", F.lit("new")), path, 4)
    assert writers.load_table(spark, path).groupBy("v").count().collect()[0][:] == ("new", 50)


def test_audited_reads(spark, tmp_path):
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    path = str(tmp_path / "audit")
    writers.audit(spark.range(3).selectExpr("id AS call_id"), path, "save")
    writers.audit(spark.range(2).selectExpr("id AS call_id"), path, "read")
    assert spark.read.parquet(path).count() == 5
    calls = spark.createDataFrame([(1, None), (2, None), (3, "gone"), (4, None)], "call_id long, deleted_at string")
    segs = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "b"), (3, 0, "c")], "call_id long, seq long, t string").withColumn(
        "text_encrypted", store.encrypted(F.col("t"), key)).drop("t")
    ids = spark.createDataFrame([(1,), (1,), (3,), (4,), (9,)], "call_id long")
    for _ in range(2):  # the job is run again
        got = writers.audited_read(calls, segs, ids, key, path, "job-7", "ann")
    assert sorted(tuple(r) for r in got.select("call_id", "seq", "text_original").collect()) == [(1, 0, "a"), (1, 1, None)]
    rows = spark.read.parquet(path).filter("run = 'job-7'").select("actor", "action", "call_id", "detail").collect()
    assert sorted(map(tuple, rows)) == [("ann", "read_transcript", "1", "segments=2 opened=1"), ("ann", "read_transcript", "4", "segments=0 opened=0")]
    shut = writers.audited_read(calls, segs, ids, other, path, "job-8", "bob")
    assert shut.filter("text_original is not null").count() == 0
    assert {r.detail for r in spark.read.parquet(path).filter("actor = 'bob'").collect()} == {"segments=2 opened=0", "segments=0 opened=0"}
    with pytest.raises(ValueError, match="run id"):
        writers.audit(calls, path, "read", run_id="../x")


NOISY = ["ваш... ваш счет ээ будет заблокирован на 3 000 000 тенге", "[шум] переведите 250000 тенге на безопасный счет эээ срочно",
         "установите эни деск и назовите код из смс", "сіздің картаңыз ммм заблокирована, 4 цифры айтыңыз"]


def test_cleanup_keeps_protected_material(spark):
    stems = LEXICON.protected_stems()
    out = T.normalize(spark.createDataFrame([(t,) for t in NOISY], "text string"), "text", stems)
    kept = out.select(T.preserves(T.protected(F.col("text"), stems), F.col("text_clean")).alias("ok"), "text_clean").collect()
    assert all(r.ok for r in kept)
    assert any("AnyDesk" in r.text_clean for r in kept)


def test_masking_hides_secrets_and_keeps_amounts(spark):
    df = spark.createDataFrame([("Код 4821, переведите 3 000 000 тенге",), ("Номер карты 4400 4301 2345 6789",)], "t string")
    a, b = [r.m for r in df.select(M.mask_sensitive(F.col("t")).alias("m")).collect()]
    assert "4821" not in a.text and "3 000 000" in a.text and a.labels == ["OTP_OR_PIN"]
    assert "4400" not in b.text and b.labels == ["CARD_NUMBER"]


def test_language(spark):
    df = spark.createDataFrame([("Здравствуйте, ваш счет заблокирован.", "ru"), ("Сіздің шотыңыз бұғатталды.", "kk"),
                                ("Сіздің картаңыз заблокирована.", "mixed"), ("", "unknown")], "t string, want string")
    assert df.filter(T.detect_language(F.col("t")) != F.col("want")).count() == 0
