"""The text operators against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callward.llm import decontaminate, lines, minhash, packing, passages, quality, tokens, toxicity
from callward.operators import cut

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, score string, n int, comp int, h string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def odd_rows():
    same = "one two three four five six seven eight nine ten"
    rows = [(1, same), (2, same), (2, same), (3, None), (4, ""), (5, "   \n\t "), (None, same), (None, None), (6, "two words"),
            (7, "Two WORDS"), (8, LONG), (9, LONG + " tail"), (10, "ü ß É\n\n12 a@b.c <|endoftext|>"), (11, "x " * 5000)]
    return [(i, t, "en", None if i == 7 else "s", None, "k", "no", "x", 3, 4, "h") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- token counts ----------------------------------------------------------------------


def test_counts_follow_random_edits():
    counter, rng = tokens.Counter(tokens.tokenizer_path()), random.Random(3)
    bits = [" ", "  ", "\n", "'", "'s", "'ll", "l", "ve", " the", "a", "é", "12", "!", "?!", "\t", "<|endoftext|>", "ß", "🙂"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        tree = tokens.tree_of(text, counter)
        assert tree.n_tokens == counter.whole(text)
        for _ in range(rng.randint(1, 5)):
            insert = "".join(rng.choice(bits) for _ in range(rng.choice([0, 0, 1, 2, 5])))
            tree = tokens.Tree.unpack(tree.pack())
            text = tokens.apply(text, tree, rng.randint(-2, len(text) + 3), rng.choice([0, 0, 1, 2, 5, 50]), insert, counter)
            assert (tree.n_tokens, int(tree.chars[-1][0])) == (counter.whole(text), len(text))


def test_an_edit_recounts_its_neighbourhood_only():
    counter = tokens.Counter(tokens.tokenizer_path())
    tree = tokens.tree_of(LONG, counter)
    asked = counter.asked
    tokens.apply(LONG, tree, 70_000, 3, "new words here", counter)
    assert counter.asked - asked < 12


def test_edits_of_a_column_and_of_a_rule(spark, odd, none):
    path = tokens.tokenizer_path()
    rule = tokens.replacing("[0-9]+|@", {}, "#")
    whole = tokens.Counter(path).whole
    out = tokens.edit(odd, path, rule).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        assert r["n_tokens_after"] == whole(r["text"])
    by = {r["doc_id"]: r for r in out}
    assert by[10]["n_edits"] == 2 and by[4]["n_tokens"] == 0 and by[3]["n_tokens_after"] == 0
    trees = tokens.build(odd.where("doc_id in (1, 6)"), path).join(odd.select("doc_id", "text"), "doc_id")
    edits = F.expr("array(named_struct('start', 0, 'delete', 3, 'insert', 'uno '), null, named_struct('start', cast(null as int), 'delete', 1, 'insert', cast(null as string)))")
    for r in tokens.edit(trees.withColumn("edits", edits), path).collect():
        assert r["n_tokens_after"] == whole(r["text"]) and r["n_edits"] == 2
    assert tokens.edit(none, path, rule).count() == 0


# --- the classifiers -----------------------------------------------------------------


@pytest.mark.parametrize(("model", "label", "fold", "held"), [(toxicity, "toxic", 4, 2), (quality, "quality", 3, 1)])
def test_held_out_accuracy(spark, model, label, fold, held):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held
    scored = model.score(d, model.fit(d, lab, label, ~out, rows=3000)).join(lab, "doc_id").where(out).select("score", label).collect()
    y = np.array([r[1] for r in scored])
    s = np.array([r[0] for r in scored])
    rank = np.argsort(np.argsort(s)) + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.97


def test_toxicity_knows_unseen_misspellings():
    rng = random.Random(1)
    words = ["table", "river", "stone", "garden", "window", "paper", "green", "walk"]
    clean = [(" ".join(rng.choices(words, k=60)), 0, 1.0) for _ in range(300)]
    bad = [(" ".join(rng.choices(words, k=30) + [rng.choice(["scoundrel", "villain"])] + rng.choices(words, k=30)), 1, 1.0) for _ in range(300)]
    model = toxicity.train(clean + bad)
    s = toxicity.scores(pa.array([" ".join(words * 9 + ["scoundrell", "villainn"]), " ".join(words * 9), "", None]), model)
    assert s[0] > 0.5 > s[1] and s[2] == s[3]


@pytest.mark.parametrize("model", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, odd, none, model):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (2, 1, "x"), (8, 0, "x"), (None, 0, "x"), (4, None, "x"), (77, 0, "x")], "doc_id long, y int, text string")
    everyone = F.lit(True)
    for lab in (labels, labels.limit(0), labels.where("y = 1")):
        out = model.score(odd, model.fit(odd, lab, "y", everyone)).collect()
        assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    fitted = model.fit(none, labels, "y", everyone)
    assert model.score(none, fitted).count() == 0 and model.score(odd, fitted).where("score <> 0.5").count() == 0


# --- line dedup ------------------------------------------------------------------------


def test_line_dedup_removes_what_a_host_repeats(spark, odd, none):
    rows = [(i, f"common line\nown {i}\n\nlast {i % 7}", "h") for i in range(40)] + [(100, "common line", "h"), (101, "common line\nx", "small"), (102, None, "h")]
    got = by_id(lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[3]["text"] == "own 3\n\n" + "" or got[3]["text"].startswith("own 3")
    assert "common line" not in got[3]["text"] and got[100]["text"] == "common line"
    assert got[101]["text"] == "common line\nx" and got[102]["text"] is None
    assert lines.dedup(odd).columns == odd.columns and lines.dedup(odd).count() == odd.count()
    assert lines.dedup(none).count() == 0


def test_line_dedup_counts_small_hosts_alike(spark):
    rows = [(i, f"menu line\nown {i}", "h") for i in range(19)] + [(50, "one page\nonly", "single")]
    got = by_id(lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all(got[i]["text"] == f"own {i}" for i in range(19)) and got[50]["text"] == "one page\nonly"


# --- near-duplicates ----------------------------------------------------------------------


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    at = {i: i for i in sets}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                at[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_groups_equal_brute_force_with_many_near_copies(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 999)}" for _ in range(90)]
        for k in range(60):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            rows.append((g * 1000 + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_groups(rows)


def test_near_groups_on_odd_rows(odd, none):
    out = minhash.groups(odd).collect()
    assert len(out) == len(odd_rows())
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert got[2]["component_id"] == 1 and not got[2]["kept"] and got[9]["component_id"] == 8 and got[7]["component_id"] == 6
    assert got[4]["component_id"] == 4 and got[3]["kept"] and got[5]["n_shingles"] == 0
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    kept = minhash.unique(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 10, 11]
    assert minhash.groups(none).count() == 0 and minhash.unique(none).count() == 0


def test_repeated_rows_leave_one(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand in here now")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash.unique(rows).collect()) == [1, 2]


# --- repeated passages ---------------------------------------------------------------------


def test_passages_found_where_they_repeat(spark, odd, none):
    rng = random.Random(9)
    fresh = lambda n: [f"v{rng.randint(0, 10**7)}" for _ in range(n)]
    shared, edited = fresh(60), fresh(120)
    changed = [w if k % 40 != 20 else "zz" for k, w in enumerate(edited)]
    short = fresh(40)
    rows = [(1, fresh(100) + shared + fresh(80)), (2, shared + fresh(30)), (3, fresh(300)), (4, fresh(50) + edited), (5, fresh(9) + changed + fresh(5)),
            (6, short + fresh(60)), (7, fresh(60) + short)] + [(20 + k, fresh(k) + shared) for k in range(30)]
    out = passages.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    got = collections.defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["start_word"], r["end_word"], r["passage_of"]))
    assert got[1] == [(100, 160, 1)] and got[2] == [(0, 60, 1)] and all(got[20 + k] == [(k, k + 60, 1)] for k in range(30))
    assert set(got) == {1, 2, 4, 5, *range(20, 50)}
    assert got[5][0][0] <= 30 and got[5][0][1] >= 100 and got[5][0][2] == 4
    odd_found = {r["doc_id"] for r in passages.repeated(odd).collect()}
    assert {8, 9} <= odd_found and not odd_found & {1, 2, 3, 4, 5, 6, 7, 10}
    assert passages.repeated(none).count() == 0


@pytest.mark.parametrize("swap", [False, True])
def test_an_insertion_counts_alike_in_both_texts(swap):
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    before, after = fresh(26), fresh(26)
    short, long = np.concatenate((fresh(70), before, fresh(4), after, fresh(40))), np.concatenate((fresh(30), before, fresh(9), after, fresh(50)))
    a, b = (long, short) if swap else (short, long)
    want = [(30, 91), (70, 126)] if swap else [(70, 126), (30, 91)]
    assert passages.best_stretches(a, b, 46) == [(*want[0], *want[1])]


@pytest.mark.parametrize("swap", [False, True])
def test_a_line_that_also_stands_before_the_passage(spark, swap):
    rng = random.Random(4)
    fresh = lambda n: [f"v{rng.randint(0, 10**7)}" for _ in range(n)]
    passage = fresh(51)
    rows = [fresh(60) + passage[20:30] + fresh(10) + passage + fresh(60), fresh(20) + passage + fresh(25)]
    want = {(80, 131), (20, 71)}
    out = passages.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows[::-1] if swap else rows)], "doc_id long, text string"))
    assert {(r["start_word"], r["end_word"]) for r in out.collect()} == want


def test_passages_near_the_threshold_are_found(spark):
    """Every pair of documents with an edited passage, each pair on its own."""
    rng = random.Random(12)
    rows, want = [], set()
    for k in range(500):
        passage = [f"p{k}w{n}" for n in range(54)]
        changed = list(passage)
        changed[27] = "zz"
        own, other = ({tuple(w[n:n + 5]) for n in range(50)} for w in (passage, changed))
        assert len(own & other) / len(own | other) >= 0.75
        for i, w in ((2 * k, passage), (2 * k + 1, changed)):
            rows.append((i, " ".join([f"x{rng.randint(0, 10**9)}" for _ in range(30)] + w + [f"x{rng.randint(0, 10**9)}" for _ in range(30)])))
            want.add((i, 2 * k))
    out = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["passage_of"]) for r in out} == want


@pytest.mark.parametrize("block", [1024, 5])
def test_passages_behind_a_frequent_line_are_found(spark, monkeypatch, block):
    """Pairs of documents that share a passage, which holds a line that stands in all documents."""
    rng = random.Random(21)
    fresh = lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    line, rows, want = fresh(38), [], set()
    for k in range(60):
        passage = fresh(6) + line + fresh(7)
        for i in (k, 100 + k * 37 % 60):
            rows.append((i, " ".join(fresh(40) + passage + fresh(40))))
            want.add((i, 40, 91, k))
    rows += [(200 + k, " ".join(fresh(50) + line + fresh(50))) for k in range(60)]
    monkeypatch.setattr(passages, "BLOCK", block)
    out = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hashes=1, agree=1).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["passage_of"]) for r in out} == want


def test_passages_leave_only_their_result_on_disk(spark):
    """Shuffle files and the tables between the steps are gone when the operator returns."""
    rng = random.Random(31)
    fresh = lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    line, shared, rows = fresh(38), fresh(60), []
    for k in range(20):
        rows.append((k, " ".join(fresh(30) + line + fresh(40 + k) + (shared if k % 2 else []) + fresh(20))))
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
    tables, kept = set(root.iterdir()), shuffles()
    out = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert len(shuffles() - kept) <= 1  # of a question that needs no table
    left = {p.name.split("-")[0] for p in set(root.iterdir()) - tables if any(p.rglob("*.parquet"))}
    assert not left & {"meetings", "texts", "candidates", "contexts", "pairs", "members", "mixed", "asked"}
    assert {r["doc_id"] for r in out.collect()} == set(range(1, 20, 2))
    assert spark.conf.get(cut.CLEANED, None) in (None, "false")


def test_of_the_first_text_only_the_stretch_travels(spark):
    """Intervals at both ends and in the middle of long texts, several pairs of one document."""
    rng = random.Random(33)
    fresh = lambda n: [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
    one, two, three = fresh(55), fresh(70), fresh(50)
    rows = [(1, one + fresh(900) + two + fresh(700) + three), (2, fresh(400) + one), (3, two + fresh(10)), (4, fresh(3) + three + fresh(500)), (5, fresh(80) + two + fresh(60) + three)]
    out = passages.repeated(spark.createDataFrame([(i, " \t".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    want = {(1, 0, 55, 1), (1, 955, 1025, 1), (1, 1725, 1775, 1), (2, 400, 455, 1), (3, 0, 70, 1), (4, 3, 53, 1), (5, 80, 150, 1), (5, 210, 260, 1)}
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["passage_of"]) for r in out} == want


def test_intervals_compared_together_give_what_each_gives():
    """Repetitive, edited and unlike texts in one step, as parts of texts and alone."""
    rng = np.random.default_rng(6)
    fresh = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    table = np.zeros(1 << passages.SLOTS, np.int32)
    calls, want = [], []
    for k in range(120):
        base = fresh(200) if k % 3 else rng.choice(fresh(k // 3 + 1), 200)
        other = base.copy()
        other[rng.integers(0, 200, k % 12)] = fresh(k % 12)
        a, b = np.concatenate((fresh(k), base, fresh(9))), np.concatenate((other[:90], fresh(k % 7), other[90:], base[:k]))
        both = passages.Pair(passages.Text(a), passages.Text(b), table)
        for p, q, s, e in ((0, len(a), 0, len(b)), (k, k + 130, 20, 160)):
            calls.append(both.call(p, q, s, e, p - s))
            want.append(passages.best_stretches(a[p:q], b[s:e], 46, d=p - s))
            for a0, a1, b0, b1 in want[-1]:
                one, two = set(a[p:q][a0:a1].tolist()), set(b[s:e][b0:b1].tolist())
                assert a1 - a0 >= 46 and b1 - b0 >= 46 and len(one & two) >= 0.75 * len(one | two)
    got = passages._stretches(calls, 46)
    assert [sorted(x) for x in got] == [sorted(x) for x in want]
    assert sum(map(len, got)) > 150


@pytest.mark.parametrize("block", [1024, 7])
def test_shingles_in_common_are_counted_exactly(monkeypatch, block):
    """Also without the hashes that a single set has, where each set is among the others, and with the same table again."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 1 << 16, rng.integers(0, 50)).astype(np.uint16)) for k in range(30)]
    raw, column = [x.tobytes() for x in sets], np.full(1 << 16, -1)
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (passages._near(raw[:9], raw[9:], column, 1) == want[:9, 9:]).all()
    twice = passages._near(raw[:9], raw, column, 2)
    apart = np.arange(9)[:, None] != np.arange(30)
    assert (twice[apart] == want[:9][apart]).all() and (column == -1).all()


def test_texts_travel_once_to_the_pairs_of_a_family(spark):
    """All pairs of 60 documents meet 60 texts; a family that is larger than a cell is cut into cells, and no pair is lost."""
    def dealt(n):
        pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n)], "a long, b long") \
            .withColumn("spans", F.expr("array(named_struct('d', 0, 's', 0, 'e', 60, 'ms', array(30)))"))
        return [(r["cell"], r["a"], r["b"]) for r in passages._dealt(pairs).collect()]

    texts = lambda rows: len({(c, x) for c, *ends in rows for x in ends})
    few, many = dealt(60), dealt(200)
    assert len(few) == 60 * 59 // 2 and texts(few) == 60
    assert len({x[1:] for x in many}) == 200 * 199 // 2 and texts(many) <= 2 * 4 * 200
    assert max(collections.Counter(c for c, *_ in many).values()) < 2 * passages.CELL**2


def test_compact_windows_cover_every_stretch_once():
    h = np.random.default_rng(1).integers(0, 6, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    left, centre, right, _ = passages.compact_windows(h, 0, 5)
    for i in range(40):
        for j in range(i + 5, 41):
            assert sum(a <= i <= c < j <= b for a, c, b in zip(left, centre, right, strict=True)) == 1


# --- decontamination -----------------------------------------------------------------------


def brute_hits(text, items):
    cut = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER)) if w]
    w, hit, met = cut(text), set(), set()
    for item, t in items:
        own = cut(t)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for at in range(len(w) - n + 1):
                if w[at:at + n] == own[k:k + n]:
                    hit |= set(range(at, at + n))
                    met.add(str(item)) if item is not None else None
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, odd, none, block_bytes):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(6)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 12, 13, 14, 30]))) for k in range(12)] + [(3, text(20)), (None, text(3)), (50, None), (51, ""), (52, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, text(rng.choice([0, 2, 13, 40, 200]))) for k in range(40)] + [(100, items[5][1].upper() + "!"), (101, None), (102, "qq " * 400 + items[5][1])]
    got = by_id(decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=block_bytes))
    for i, t in rows:
        want = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == want
        assert got[i]["contaminated"] == (want[1] > 0 and 20 * want[1] >= want[0])
    item = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    kept = decontaminate.decontaminated(odd, item)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert decontaminate.decontaminated(odd, item.limit(0)).count() == odd.count()
    assert decontaminate.contamination(none, item).count() == 0


# --- packing ----------------------------------------------------------------------------------


def check_packing(rows, out, path, capacity):
    tokenizer = packing.encoder(path).tokenizer
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            want[i, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    places = collections.defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r["length"] for r in out)


def test_packing_is_exact_and_tight(spark, docs, odd, none):
    path = packing.tokenizer_path()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n, total = check_packing(rows, packing.pack(packing.pieces(docs, path)).collect(), path, 2048)
    assert n <= 1.01 * -(-total // 2048) + 1
    check_packing([r[:2] for r in odd_rows()], packing.pack(packing.pieces(odd, path, 100), 100, group_rows=5).collect(), path, 100)
    assert packing.pack(packing.pieces(none, path)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_binds(rule):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    sequence, _ = packing.fit(lengths, 100, 3, 5000.0, rule=rule)
    for s in set(sequence.tolist()):
        own = lengths[sequence == s]
        assert own.sum() <= 100 and len(own) <= 3 and ((own.astype(float) ** 2).sum() <= 5000 or len(own) == 1)


def test_sequences_hold_the_packed_ids(spark):
    path = packing.tokenizer_path()
    d = spark.createDataFrame([(1, "hello there world"), (2, "a b c"), (3, None)], "doc_id long, text string")
    out = packing.sequences(d, packing.pack(packing.pieces(d, path)), path).collect()
    ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in out), "<u4")
    tokenizer = packing.encoder(path).tokenizer
    assert sorted(ids.tolist()) == sorted([i for t in ("hello there world", "a b c", "") for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 0]])


def test_line_ratio_holds_for_hosts_of_every_size(spark):
    """Hosts of 1 to 25 pages against counting by hand."""
    rng = np.random.default_rng(4)
    rows = []
    for host in range(1, 26):
        for page in range(host):
            own = [f"line {k} of {host}" for k in range(12) if rng.random() < (k + 1) / 14]
            rows.append((len(rows), f"h{host}" if host != 7 else None, "\n".join([*own, f"only here {len(rows)}"] if page % 5 else own)))
    want = {}
    for doc, host, text in rows:
        pages = [t.split("\n") for _, h, t in rows if h == host]
        kept = [x for x in text.split("\n") if not x.strip() or (n := sum(x in p for p in pages)) < 2 or n <= 0.1 * len(pages)]
        want[doc] = "\n".join(kept) if "".join(kept).strip() else text
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()} == want
