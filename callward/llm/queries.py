"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callward.llm import ann, decontaminate, idfiles, lines, minhash, negatives, packing, passages, periodic, quality, tokens, toxicity, warc
from callward.llm.common import remainder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_edit_aware_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after numbers and addresses are masked and lines joined."""
    rule = tokens.replacing(r"[0-9]+|@|\n", {"\n": " "}, "#")
    return tokens.edit(table(spark, sf_dir, "documents"), tokens.tokenizer_path(), rule, texts=False)


def scored(spark: SparkSession, sf_dir: str, model_of, label: str, fold: int, held: int, threshold: float) -> DataFrame:
    """Fit on the labels outside the held-out fold and score every document."""
    docs, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), fold) == held
    model = model_of.fit(docs, table(spark, sf_dir, "labels"), label, ~held_out)
    return model_of.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, toxicity, "toxic", 4, 2, 0.3)


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, quality, "quality", 3, 1, 0.5)


@query("op3_warc_archive", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY 1)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1], lambda q:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(x, 5 * i + 1, 5))::BIGINT // q) % 32, 1)), '')), '')
    AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d JOIN m USING (h)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory, folder = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_back(directory, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_minhash_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
    WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS node FROM documents UNION SELECT r.id, w.b FROM r JOIN both_ways w ON w.a = r.node),
k AS (SELECT id, min(node) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN k ON k.id = s.doc_id
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


@query("op5_site_line_dedup", """
WITH r AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
hosts AS (SELECT source, count(*) AS total FROM r GROUP BY 1),
n AS (SELECT source, line, count(*) AS c FROM (SELECT source, unnest(list_distinct(ls)) AS line FROM r)
  WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
common AS (SELECT n.source, list(line) AS bad FROM n JOIN hosts ON n.source IS NOT DISTINCT FROM hosts.source
  WHERE c > 1 AND c > 0.1::DOUBLE * total GROUP BY 1),
k AS (SELECT doc_id, r.source, text, array_to_string(list_filter(ls, lambda x: NOT list_contains(bad, x)), chr(10)) AS kept
  FROM r LEFT JOIN common ON r.source IS NOT DISTINCT FROM common.source)
SELECT doc_id, source, CASE WHEN trim(replace(kept, chr(10), ''), ' ') <> '' THEN kept ELSE text END AS text FROM k
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "source", "text")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), packing.tokenizer_path())
    return packing.pack(parts)


@query("op7_repeated_passages")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


@query("op9_nearest_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.vectors(table(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, rows.where(F.col("id") % 20 == 0))


OP10_WORDS = (r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")


@query("op10_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {OP10_WORDS} AS w FROM documents),
b AS (SELECT item_id, {OP10_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op11_hard_negatives", """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.p, p.ps, s.b, s.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 50 * p.ps <= 100 * s.s AND 100 * s.s <= 95 * p.ps)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
FROM n WHERE rank <= 3
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.rows(table(spark, sf_dir, "embeddings"), label=moved), F.col("id") % 50 == 0)


PLANTED = r"""
CASE WHEN h % 10 = 0 AND size(words) > 0 THEN array_join(concat(slice(words, 1, int(g % size(words))),
  transform(sequence(int(g % size(words)), size(words) - 1), i -> words[int(g % size(words)
    + (i - g % size(words)) % (1 + (size(words) - g % size(words)) div (3 + g % 8)))])), ' ') ELSE text END
"""


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten repeats its tail with a period, as the ids say."""
    plain = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, plain).alias("words")) \
        .select("doc_id", F.expr(PLANTED).alias("text"))


@query("op12_repeated_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of the largest exact length / period, and digests of all runs and of the collapsed text."""
    found = periodic.runs(planted(table(spark, sf_dir, "documents")))
    best = F.expr("aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (best, r) -> "
                  "CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_id_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory, folder = idfiles.archive(table(spark, sf_dir, "documents"), idfiles.tokenizer_path(), end_id=2)
    return idfiles.read(directory, folder)
