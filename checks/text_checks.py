"""Checks of text functions, segments and validation (documents and conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callward import vocab as v
from callward.functions import masking as M
from callward.functions import text as T
from callward.operators import segments as S
from callward.operators import validate as V
from callward.sources import readers as R
from checks.common import (LANGS, PROSE, SPACE, SQL_SEGMENTS, SQL_TURNS, check, quote, segments, sql_canon, sql_in,
                           sql_quote_canon, sql_strip, sql_tokens, sql_ts, sql_words, table, turns)

H = "md5({})"  # long texts are compared by digest


def docs(spark, d):
    return table(spark, d, "documents")


def digest(column):
    return F.md5(column.cast("binary"))


@check("p01_canon", f"SELECT doc_id, md5({sql_canon('text')}) AS canon, md5({sql_quote_canon('text')}) AS quote FROM documents")
def p01(spark, d):
    return docs(spark, d).select("doc_id", digest(T.canon(F.col("text"))).alias("canon"),
                                 digest(T.quote_canon(F.col("text"))).alias("quote"))


@check("p02_tokens", f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n, {sql_tokens('text')}[1] AS first FROM documents")
def p02(spark, d):
    toks = T.tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(toks).cast("bigint").alias("n"), F.get(toks, F.lit(0)).alias("first"))


_VOTE = (f"CASE WHEN regexp_matches(t, '[{LANGS.first_letters}]') OR t IN {sql_in(LANGS.first_words)} THEN 1 "
         f"WHEN t IN {sql_in(LANGS.second_words)} THEN 2 WHEN regexp_matches(t, '(?:{'|'.join(LANGS.first_suffixes)})$') THEN 1 "
         f"WHEN regexp_matches(t, '[{LANGS.second_letters}]') THEN 2 ELSE 0 END")
SQL_LANG = """CASE WHEN a > 0 AND b > 0 THEN CASE WHEN least(a, b)::DOUBLE / (a + b) >= 0.2 THEN 'mixed' WHEN a > b THEN 'de' ELSE 'en' END
    WHEN a > 0 THEN 'de' WHEN b > 0 THEN 'en' ELSE 'unknown' END"""


def sql_lang(source: str, keys: str) -> str:
    return f"""votes AS (SELECT {keys}, list_transform({sql_tokens('text')}, lambda t: {_VOTE}) AS vs FROM {source}),
    ab AS (SELECT {keys}, len(list_filter(vs, lambda x: x = 1)) AS a, len(list_filter(vs, lambda x: x = 2)) AS b FROM votes),
    lang AS (SELECT {keys}, {SQL_LANG} AS detected FROM ab)"""


@check("p03_language", f"WITH {sql_lang('documents', 'doc_id, lang')} SELECT doc_id, detected FROM lang")
def p03(spark, d):
    return docs(spark, d).select("doc_id", T.detect_language(F.col("text"), LANGS).alias("detected"))


_TAG = "CASE lang WHEN 'de' THEN 'KK ' WHEN 'en' THEN ' ru' WHEN 'fr' THEN 'mixed' ELSE lang END"


@check("p04_reconcile_language", f"""WITH {sql_lang('documents', 'doc_id, lang')} SELECT doc_id, CASE
    WHEN lower(trim({_TAG})) NOT IN ('kk', 'ru', 'mixed', 'unknown') THEN detected
    WHEN detected = 'mixed' THEN 'mixed' ELSE lower(trim({_TAG})) END AS language FROM lang""")
def p04(spark, d):
    return docs(spark, d).select("doc_id", T.reconcile_language(
        F.expr(_TAG), T.detect_language(F.col("text"), LANGS)).alias("language"))


@check("p05_relabel_language", f"""WITH {sql_lang('documents', 'doc_id, lang')}
    SELECT doc_id, CASE WHEN detected <> 'unknown' THEN detected ELSE lang END AS language FROM lang""")
def p05(spark, d):
    return docs(spark, d).select("doc_id", T.relabel_language(
        F.col("lang"), T.detect_language(F.col("text"), LANGS)).alias("language"))


@check("p06_format_timestamp", f"SELECT event_id, {sql_ts('value * 60 - 100')} AS ts FROM events")
def p06(spark, d):
    return table(spark, d, "events").select("event_id", T.fmt_ts(F.col("value") * 60 - 100).alias("ts"))


_CLOCK = "CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%M:%S') END"


@check("p07_parse_timestamp", f"""SELECT event_id, CASE event_type WHEN 'error' THEN -1.0::DOUBLE
    WHEN 'view' THEN (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE ELSE (minute(ts) * 60 + second(ts))::DOUBLE END AS seconds
    FROM events""")
def p07(spark, d):
    clock = (F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", F.date_format("ts", "HH:mm:ss"))
             .otherwise(F.date_format("ts", "mm:ss")))
    return table(spark, d, "events").select("event_id", T.parse_ts(clock).alias("seconds"))


# --- cleanup --------------------------------------------------------------------------
# Notes of a call centre are imitated by marking up the documents: the markup is part
# of both the query and the SQL.

NOISY = "replace(replace(replace(text, ' the ', ' [noise] the the ... um, '), ' de ', ' <unk> de de (NOISE) '), 'ing ', 'ing  ,, ')"


def noisy(spark, d):
    return docs(spark, d).select("doc_id", F.expr(NOISY).alias("text"))


def sql_artifacts(x: str) -> str:
    words = "|".join(v.NOISE_WORDS)
    one = rf"regexp_replace({x}, '(?i)\[[^\]]{{0,30}}\]|<[^>]{{0,20}}>|\((?:{words})\)|«{SPACE}*»', ' ', 'g')"
    two = rf"regexp_replace({one}, '\.{{2,}}', ' ', 'g')"
    return sql_strip(rf"regexp_replace({two}, '{SPACE}{{2,}}', ' ', 'g')")


def sql_stutter(x: str) -> str:
    """Repeated words only: the documents hold no hyphen stutters."""
    w = sql_words(x)
    canons = f"list_transform({w}, lambda t: {sql_canon('t')})"
    return (f"array_to_string(list_transform(list_filter(list_transform({w}, lambda t, i: {{'t': t, 'i': i}}), "
            f"lambda s: s.i = 1 OR {canons}[s.i] = '' OR {canons}[s.i] <> {canons}[s.i - 1]), lambda s: s.t), ' ')")


@check("p08_strip_artifacts", f"WITH n AS (SELECT doc_id, {NOISY} AS text FROM documents) SELECT doc_id, md5({sql_artifacts('text')}) AS out FROM n")
def p08(spark, d):
    return noisy(spark, d).select("doc_id", digest(T.strip_artifacts(F.col("text"))).alias("out"))


_PAIRS = f"""n AS (SELECT doc_id, {NOISY} AS text FROM documents),
  w AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {sql_words('text')} AS ws FROM n)),
  c AS (SELECT doc_id, i, t, {sql_canon('t')} AS c FROM w),
  k AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c)"""


@check("p09_collapse_stutter", f"""WITH {_PAIRS} SELECT doc_id, md5(string_agg(t, ' ' ORDER BY i)) AS out FROM k
    WHERE p IS NULL OR c = '' OR c <> p GROUP BY doc_id""")
def p09(spark, d):
    return noisy(spark, d).select("doc_id", digest(T.collapse_stutter(F.col("text"))).alias("out"))


@check("p10_drop_fillers", f"""WITH {_PAIRS}, f AS (SELECT doc_id, count(*) FILTER (c NOT IN {sql_in(v.FILLERS)}) AS kept, count(*) AS n,
      string_agg(t, ' ' ORDER BY i) FILTER (c NOT IN {sql_in(v.FILLERS)}) AS joined FROM c GROUP BY doc_id)
    SELECT doc_id, md5(CASE WHEN kept > 0 AND kept < f.n THEN joined ELSE text END) AS out FROM n LEFT JOIN f USING (doc_id)""")
def p10(spark, d):
    return noisy(spark, d).select("doc_id", digest(T.drop_fillers(F.col("text"))).alias("out"))


FIXES = ((r"of\s?the", "ofthe", "two words joined"), (r"thing", "THING", "upper-cased"), (r"de\s+la", "dela", "joined"))


def sql_fixes(x: str) -> str:
    """Whole-word replacement without look-around: double every separator, replace, undo."""
    out = rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    for pattern, written in ((rf"of(?:{SPACE}{SPACE})?the", "ofthe"), ("thing", "THING"), (rf"de(?:{SPACE}{SPACE})+la", "dela")):
        out = rf"regexp_replace({out}, '(?i)(^|[^\p{{L}}\p{{N}}_]){pattern}([^\p{{L}}\p{{N}}_]|$)', '\1{written}\2', 'g')"
    return rf"regexp_replace({out}, '(?s)([^\p{{L}}\p{{N}}_])[^\p{{L}}\p{{N}}_]', '\1', 'g')"


@check("p11_known_fixes", f"SELECT doc_id, md5({sql_fixes('text')}) AS out FROM documents")
def p11(spark, d):
    return docs(spark, d).select("doc_id", digest(T.apply_fixes(F.col("text"), FIXES)).alias("out"))


def sql_punctuation(x: str) -> str:
    out = rf"regexp_replace({x}, '{SPACE}+([,.!?;:])', '\1', 'g')"
    # a mark repeated is reduced mark by mark, RE2 has no back references
    for mark in (",", r"\.", "!", r"\?"):
        out = rf"regexp_replace({out}, '({mark}){mark}+', '\1', 'g')"
    out = rf"regexp_replace({out}, '{SPACE}{{2,}}', ' ', 'g')"
    out = f"trim({sql_strip(out)}, ' ,;:')"
    return f"list_transform([{out}], lambda o: CASE WHEN o = '' THEN '' ELSE upper(o[1]) || o[2:] || CASE WHEN o[-1] IN ('.', '!', '?') THEN '' ELSE '.' END END)[1]"


@check("p12_restore_punctuation", f"WITH n AS (SELECT doc_id, {NOISY} AS text FROM documents) SELECT doc_id, md5({sql_punctuation('text')}) AS out FROM n")
def p12(spark, d):
    return noisy(spark, d).select("doc_id", digest(T.restore_punctuation(F.col("text"))).alias("out"))


STEMS = PROSE.protected_stems()
_STEMS = "[" + ", ".join(quote(s) for s in STEMS) + "]"


@check("p13_protected_counts", f"""WITH s AS (SELECT unnest({_STEMS}) AS stem), c AS (SELECT doc_id, {sql_canon('text')} AS hay FROM documents)
    SELECT doc_id, stem AS item, ((length(hay) - length(replace(hay, stem, ''))) // length(stem))::BIGINT AS n FROM c, s WHERE contains(hay, stem)
    UNION ALL SELECT doc_id, 'num:' || x, count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{Nd}}+')) AS x FROM documents) GROUP BY ALL""")
def p13(spark, d):
    df = docs(spark, d).select("doc_id", T.canon(F.col("text")).alias("hay"), T.number_runs(F.col("text")).alias("nums"))
    stems = F.filter(F.transform(F.array(*[F.lit(s) for s in STEMS]), lambda s: F.struct(
        s.alias("item"), T.stem_count(F.col("hay"), s).alias("n"))), lambda x: x["n"] > 0)
    nums = F.transform(F.array_distinct("nums"), lambda x: F.struct(
        F.concat(F.lit("num:"), x).alias("item"), F.size(F.filter("nums", lambda y: y == x)).cast("bigint").alias("n")))
    return df.select("doc_id", F.inline(F.concat(stems, nums)))


def _sql_rule_chain() -> str:
    """Guarded application of the five rules, a few CTEs per rule."""
    nums = "regexp_extract_all({x}, '\\p{{Nd}}+')"
    counts = (f"list_concat(list_transform({_STEMS}, lambda s: (length(cc) - length(replace(cc, s, ''))) // length(s)), "
              "list_transform(nums, lambda q: len(list_filter(cn, lambda y: y = q))))")
    fillers = f"list_filter({sql_words('cur')}, lambda t: {sql_canon('t')} NOT IN {sql_in(v.FILLERS)})"
    rules = [
        sql_artifacts("cur"), None,
        f"CASE WHEN len({fillers}) > 0 AND len({fillers}) < len({sql_words('cur')}) THEN array_to_string({fillers}, ' ') ELSE cur END",
        "cur", sql_punctuation("cur"),
    ]
    ctes = [
        f"n0 AS (SELECT doc_id, text, text AS cur, 0 AS notes, 0 AS reverted, {sql_canon('text')} AS cc, {nums.format(x='text')} AS cn, "
        f"list_distinct({nums.format(x='text')}) AS nums FROM (SELECT doc_id, {NOISY} AS text FROM documents))",
        f"f AS (SELECT doc_id, cur, nums, notes, reverted, {counts} AS base FROM n0)",
    ]
    prev = "f"
    for i, rule in enumerate(rules):
        if rule is None:
            ctes += [
                f"w{i} AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {sql_words('cur')} AS ws FROM {prev}))",
                f"k{i} AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT *, {sql_canon('t')} AS c FROM w{i}))",
                f"s{i} AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS o FROM k{i} WHERE p IS NULL OR c = '' OR c <> p GROUP BY doc_id)",
                f"c{i} AS (SELECT x.*, coalesce(o, '') AS cand FROM {prev} x LEFT JOIN s{i} USING (doc_id))",
            ]
        else:
            ctes.append(f"c{i} AS (SELECT *, {rule} AS cand FROM {prev})")
        ctes += [
            f"d{i} AS (SELECT *, {sql_canon('cand')} AS cc, {nums.format(x='cand')} AS cn FROM c{i})",
            f"g{i} AS (SELECT *, {counts} AS after FROM d{i})",
            f"e{i} AS (SELECT *, CASE WHEN cand = cur THEN 0 WHEN len(list_filter(list_zip(base, after), lambda z: z[2] < z[1])) = 0 THEN 1 ELSE 2 END AS step FROM g{i})",
            f"f{i} AS (SELECT doc_id, CASE WHEN step = 1 THEN cand ELSE cur END AS cur, nums, notes + (step = 1)::INT AS notes, "
            f"reverted + (step = 2)::INT AS reverted, base FROM e{i})",
        ]
        prev = f"f{i}"
    return "WITH " + ",\n".join(ctes) + f" SELECT doc_id, md5(cur) AS out, notes::INT AS notes, reverted::INT AS reverted FROM {prev}"


@check("p14_guarded_cleanup", _sql_rule_chain())
def p14(spark, d):
    out = T.normalize(noisy(spark, d), "text", STEMS)
    return out.select("doc_id", digest(F.col("text_clean")).alias("out"), F.size("notes").alias("notes"),
                      F.size("reverted").alias("reverted"))


# --- masking ---------------------------------------------------------------------------

# Digit groups are joined greedily while the joined run stays within 24 characters.
SQL_MASK = f"""g0 AS (SELECT doc_id, text, regexp_extract_all(text, '\\p{{Nd}}+') AS gs, string_split_regex(text, '\\p{{Nd}}+') AS ps FROM documents),
  g1 AS (SELECT doc_id, text, unnest(range(1, len(gs) + 1)) AS i, gs, ps FROM g0 WHERE len(gs) > 0),
  g2 AS (SELECT doc_id, text, i, gs[i] AS grp, ps[i] AS sep, sum(length(ps[i]) + length(gs[i])) OVER (PARTITION BY doc_id ORDER BY i) AS fin FROM g1),
  fold AS (SELECT doc_id, i, i AS run, length(grp) AS len FROM g2 WHERE i = 1
    UNION ALL SELECT f.doc_id, g.i,
      CASE WHEN regexp_full_match(g.sep, '[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}-]+') AND f.len + length(g.sep) + length(g.grp) <= 24 THEN f.run ELSE g.i END,
      CASE WHEN regexp_full_match(g.sep, '[\\t-\\r\\x1c-\\x20\\x85\\p{{Z}}-]+') AND f.len + length(g.sep) + length(g.grp) <= 24
        THEN f.len + length(g.sep) + length(g.grp) ELSE length(g.grp) END
    FROM fold f JOIN g2 g ON g.doc_id = f.doc_id AND g.i = f.i + 1),
  r2 AS (SELECT doc_id, any_value(text) AS text, run AS i, max(fin) AS fin, max(len) AS len, sum(length(grp)) AS digits
    FROM fold JOIN g2 USING (doc_id, i) GROUP BY doc_id, run),
  r3 AS (SELECT *, substr(text, (fin - len + 1)::BIGINT, len) AS body, right(substr(text, 1, (fin - len)::BIGINT), 28) AS before,
      substr(text, (fin + 1)::BIGINT, 14) AS after, coalesce(lag(fin) OVER (PARTITION BY doc_id ORDER BY i), 0) AS prev FROM r2),
  r4 AS (SELECT *, substr(text, (prev + 1)::BIGINT, (fin - len - prev)::BIGINT) AS piece, CASE WHEN len NOT BETWEEN 3 AND 24 THEN NULL WHEN digits >= 12 THEN 'CARD_NUMBER'
      WHEN regexp_matches(after, '(?i)^{SPACE}*(?:{"|".join(v.CURRENCY_WORDS)})') THEN NULL
      WHEN digits BETWEEN 3 AND 8 AND regexp_matches(before, '(?i){"|".join(v.CREDENTIAL_CUES)}') THEN 'OTP_OR_PIN' END AS kind FROM r3)"""


@check("p17_mask_sensitive", f"""WITH RECURSIVE {SQL_MASK}, m AS (SELECT doc_id, string_agg(piece || CASE kind WHEN 'CARD_NUMBER' THEN {quote(v.CARD_MASK)}
      WHEN 'OTP_OR_PIN' THEN {quote(v.CODE_MASK)} ELSE body END, '' ORDER BY i) || substr(any_value(text), max(fin)::BIGINT + 1) AS masked,
      coalesce(string_agg(kind, '|' ORDER BY i), '') AS labels FROM r4 GROUP BY doc_id)
    SELECT doc_id, md5(coalesce(masked, text)) AS masked, coalesce(labels, '') AS labels FROM documents LEFT JOIN m USING (doc_id)""")
def p17(spark, d):
    return docs(spark, d).withColumn("m", M.mask_sensitive(F.col("text"))).select(
        "doc_id", digest(F.col("m.text")).alias("masked"), F.array_join("m.labels", "|").alias("labels"))


# --- rendering and small scalars ----------------------------------------------------------

SQL_LINE = f"""'[' || {sql_ts('start')} || '] ' || speaker || ' (' || 'x' || '): ' || text"""


@check("p19_render_transcript", f"""WITH {SQL_SEGMENTS}, {sql_lang('seg', 'call_id, seq')} SELECT call_id, md5(string_agg('[' || {sql_ts('start')} || '] '
    || speaker || ' (' || detected || ') (asr=' || format('{{:.2f}}', confidence) || '): ' || text, chr(10) ORDER BY seq)) AS transcript
    FROM (SELECT s.*, CASE WHEN l.detected IN ('mixed', 'unknown') THEN l.detected ELSE l.detected END AS detected FROM seg s JOIN lang l USING (call_id, seq)) GROUP BY call_id""")
def p19(spark, d):
    return S.render(segments(spark, d), with_confidence=True).select("call_id", digest(F.col("transcript")).alias("transcript"))


def _facts(spark, d):
    from callward.operators.verdict import call_facts

    seg = segments(spark, d)
    return seg, call_facts(seg)


@check("p20_prompt_table", f"""WITH {SQL_SEGMENTS}, f AS (SELECT call_id, max(call_direction) AS dir, max(start + d) AS dur, avg(confidence) AS mc FROM seg GROUP BY call_id)
    SELECT call_id, 'call_direction: ' || dir || chr(10) || 'dominant_language: x' || chr(10) || 'duration_seconds: ' || floor(dur)::BIGINT
      || CASE WHEN mc < 0.8 THEN chr(10) || 'mean_asr_confidence: ' || format('{{:.2f}}', mc) || ' (noisy transcript)' ELSE '' END AS meta FROM f""")
def p20(spark, d):
    seg, facts = _facts(spark, d)
    out = S.prompts(seg, facts, facts.select("call_id", F.lit("x").alias("dominant")))
    meta = F.regexp_extract("prompt", r"(?s)METADATA\n(.*?)\n\nTRANSCRIPT\n", 1)
    return out.select("call_id", meta.alias("meta"))


@check("p21_score_bar", """SELECT event_id, repeat('█', round_even(least(100, floor(value)) / 5, 0)::INT)
    || repeat('░', 20 - round_even(least(100, floor(value)) / 5, 0)::INT) AS bar FROM events""")
def p21(spark, d):
    score = F.least(F.lit(100), F.floor("value").cast("int"))
    return table(spark, d, "events").select("event_id", T.score_bar(score).alias("bar"))


@check("p22_segment_flags", f"""WITH {SQL_SEGMENTS} SELECT call_id, seq, confidence < 0.55 AS low_asr,
    CASE WHEN confidence < 0.5 THEN 'low diarization confidence (' || format('{{:.2f}}', confidence) || ')' END AS diarization_note FROM seg""")
def p22(spark, d):
    return S.flags(segments(spark, d).withColumn("diarization_confidence", F.col("confidence"))).select(
        "call_id", "seq", "low_asr", "diarization_note")


@check("p23_asr_confidence", """SELECT event_id, round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, pow(2.0::DOUBLE, 0.5::DOUBLE - value / 20.7::DOUBLE))), 3) AS a,
    round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - value / 41.3::DOUBLE)), 3) AS b FROM events""")
def p23(spark, d):
    value = F.col("value")
    return table(spark, d, "events").select(
        "event_id", T.confidence_from_logprob(0.5 - value / 20.7).alias("a"),
        T.confidence_from_no_speech(value / 41.3).alias("b"))


# --- turns to segments ---------------------------------------------------------------------

@check("s04_segments", f"""WITH {SQL_SEGMENTS} SELECT call_id, seq, speaker, round(start, 6) AS start, round(start + d, 6) AS "end",
    round(confidence, 6) AS confidence, md5(text) AS text FROM seg""")
def s04(spark, d):
    return segments(spark, d).select(
        "call_id", "seq", "speaker", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"),
        F.round("confidence", 6).alias("confidence"), digest(F.col("text")).alias("text"))


BLANKED = "CASE WHEN length(text) % 5 = 0 THEN '  ' ELSE text END"


@check("w01_reindex", f"""WITH {SQL_TURNS} SELECT call_id, turn, row_number() OVER (PARTITION BY call_id ORDER BY turn) - 1 AS seq
    FROM turns WHERE trim({BLANKED}) <> ''""")
def w01(spark, d):
    from callward.operators.prefix import blocks_of, running

    df = turns(spark, d).withColumn("text", F.expr(BLANKED)).filter(T.strip(F.col("text")) != "")
    return running(df, ["call_id"], ["turn"], blocks_of(F.col("turn"), 3), {"seq": ("count", F.lit(1))}).select(
        "call_id", "turn", F.col("seq").cast("bigint").alias("seq"))


@check("f01_blank_turns", f"WITH {SQL_TURNS} SELECT call_id, count(*) AS n FROM turns WHERE trim({BLANKED}) <> '' GROUP BY call_id")
def f01(spark, d):
    df = turns(spark, d).withColumn("text", F.expr(BLANKED))
    return S.from_turns(df, clean=False, pair=LANGS).groupBy("call_id").agg(F.count("*").alias("n"))


#: some turns carry a start, some an end
_GIVEN_START = "CASE WHEN length(text) % 4 = 0 THEN (turn * 11 + 3)::DOUBLE END"
_GIVEN_END = "CASE WHEN length(text) % 3 = 0 THEN (turn * 11 + 8)::DOUBLE END"


@check("w02_timeline", f"""WITH RECURSIVE {SQL_TURNS}, t AS (SELECT call_id, turn, {_GIVEN_START} AS gs, {_GIVEN_END} AS ge,
      greatest(2::DOUBLE, least(9::DOUBLE, length({sql_strip('text')})::DOUBLE / 14)) AS d FROM turns),
    fold AS (SELECT DISTINCT call_id, -1::BIGINT AS turn, 0::DOUBLE AS start, 0::DOUBLE AS fin, 1.5::DOUBLE AS cursor FROM t
      UNION ALL SELECT f.call_id, t.turn, coalesce(gs, cursor), coalesce(ge, coalesce(gs, cursor) + d),
        greatest(coalesce(ge, coalesce(gs, cursor) + d) + 6 - d, coalesce(ge, coalesce(gs, cursor) + d) + 0.6::DOUBLE)
      FROM fold f JOIN t ON t.call_id = f.call_id AND t.turn = f.turn + 1)
    SELECT call_id, turn AS seq, round(start, 6) AS start, round(greatest(start, fin), 6) AS "end" FROM fold WHERE turn >= 0""")
def w02(spark, d):
    df = turns(spark, d).withColumns({
        "start": F.expr(_GIVEN_START.replace("::DOUBLE", "")).cast("double"),
        "end": F.expr(_GIVEN_END.replace("::DOUBLE", "")).cast("double")})
    return S.from_turns(df, clean=False, pair=LANGS, block=3).select(
        "call_id", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@check("s05_parse_lines", f"""WITH l AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS turn
      FROM (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'victim : ' WHEN 'assistant' THEN 'CALLER:' ELSE role || ': ' END || text, chr(10) ORDER BY turn) AS body
        FROM conversations GROUP BY conv_id)),
    p AS (SELECT conv_id, turn, {sql_strip('raw')} AS line FROM l),
    q AS (SELECT *, CASE WHEN contains(line, ':') THEN upper({sql_strip("regexp_extract(line, '^([^:]*):', 1)")}) ELSE '' END AS name,
      CASE WHEN contains(line, ':') THEN {sql_strip("regexp_extract(line, '(?s)^[^:]*:(.*)$', 1)")} ELSE '' END AS body FROM p WHERE line <> '')
    SELECT conv_id, turn, CASE WHEN name IN ('CALLER', 'VICTIM', 'UNKNOWN') AND body <> '' THEN name ELSE 'UNKNOWN' END AS speaker,
      md5(CASE WHEN name IN ('CALLER', 'VICTIM', 'UNKNOWN') AND body <> '' THEN body ELSE line END) AS text FROM q""")
def s05(spark, d):
    conv = table(spark, d, "conversations")
    label = F.when(F.col("role") == "user", "victim : ").when(F.col("role") == "assistant", "CALLER:").otherwise(
        F.concat("role", F.lit(": ")))
    pasted = conv.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "turn", F.concat(label, "text").alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return R.parse_lines(pasted).select("conv_id", "turn", "speaker", digest(F.col("text")).alias("text"))


@check("f02_by_speaker", f"WITH {SQL_SEGMENTS} SELECT call_id, seq FROM seg WHERE speaker = 'CALLER'")
def f02(spark, d):
    return R.by_speaker(segments(spark, d), "CALLER").select("call_id", "seq")


@check("f03_browse", """SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 1000""")
def f03(spark, d):
    df = docs(spark, d).withColumns({"language_mode": F.col("lang"), "asr_noisy": F.col("n_chars") > 1000})
    return R.browse(df, "en", True).select("doc_id")


@check("a01_call_duration", f"WITH {SQL_SEGMENTS} SELECT call_id, round(max(start + d), 6) AS duration FROM seg GROUP BY call_id")
def a01(spark, d):
    return _facts(spark, d)[1].select("call_id", F.round("duration", 6).alias("duration"))


@check("a04_mean_confidence", f"WITH {SQL_SEGMENTS} SELECT call_id, round(avg(confidence), 6) AS mean_confidence FROM seg GROUP BY call_id")
def a04(spark, d):
    return _facts(spark, d)[1].select("call_id", F.round("mean_confidence", 6).alias("mean_confidence"))


#: sources as calls, documents as segments with a language tag each
_LTAG = "CASE lang WHEN 'de' THEN 'kk' WHEN 'en' THEN 'ru' WHEN 'fr' THEN 'mixed' ELSE 'unknown' END"
SQL_PROFILE = f"""p AS (SELECT source AS call_id, {_LTAG} AS language, count(*) AS c FROM documents GROUP BY ALL),
  q AS (SELECT *, round(c::DOUBLE / sum(c) OVER (PARTITION BY call_id), 3) AS share FROM p)"""


def _profile(spark, d):
    return S.language_profile(docs(spark, d).select(F.col("source").alias("call_id"), F.expr(_LTAG).alias("language")))


@check("a02_language_profile", f"WITH {SQL_PROFILE} SELECT call_id, language, share FROM q")
def a02(spark, d):
    return _profile(spark, d).select("call_id", F.explode("profile").alias("language", "share"))


@check("a03_dominant_language", f"""WITH {SQL_PROFILE}, m AS (SELECT call_id, coalesce(max(share) FILTER (language = 'mixed'), 0) AS mx,
      coalesce(max(share) FILTER (language = 'kk'), 0) AS kk, coalesce(max(share) FILTER (language = 'ru'), 0) AS ru FROM q GROUP BY call_id),
    t AS (SELECT call_id, language FROM q QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY share DESC, language) = 1)
    SELECT call_id, CASE WHEN mx >= 0.25 OR (kk > 0.2 AND ru > 0.2) THEN 'mixed' ELSE language END AS dominant FROM m JOIN t USING (call_id)""")
def a03(spark, d):
    return _profile(spark, d).select("call_id", "dominant")


# --- validation --------------------------------------------------------------------------------

_NAMES = ("VIEW", "ERROR", "SIGN_UP")


@check("v01_clean_labels", """WITH l AS (SELECT user_id, event_id, unnest([' ' || event_type, 'sign up', event_type, lower(event_type)]) AS x,
      unnest([1, 2, 3, 4]) AS i FROM events), n AS (SELECT *, replace(upper(trim(x)), ' ', '_') AS y FROM l),
    f AS (SELECT event_id, y, min(i) AS i FROM n WHERE y IN ('VIEW', 'ERROR', 'SIGN_UP') GROUP BY ALL)
    SELECT e.event_id, coalesce(string_agg(y, '|' ORDER BY f.i), '') AS labels FROM events e LEFT JOIN f USING (event_id) GROUP BY e.event_id""")
def v01(spark, d):
    raw = F.array(F.concat(F.lit(" "), "event_type"), F.lit("sign up"), F.col("event_type"), F.lower("event_type"))
    return table(spark, d, "events").select("event_id", F.array_join(V.clean_labels(raw, _NAMES), "|").alias("labels"))


_STAGE = "CASE event_type WHEN 'view' THEN ' payment' WHEN 'error' THEN 'exit ' WHEN 'click' THEN NULL ELSE event_type END"


@check("v02_stage_default", f"""SELECT event_id, CASE WHEN upper(trim(coalesce({_STAGE}, ''))) IN {sql_in(v.STAGE_DEPTH)}
    THEN upper(trim({_STAGE})) ELSE 'UNKNOWN' END AS stage FROM events""")
def v02(spark, d):
    return table(spark, d, "events").select("event_id", V.clean_stage(F.expr(_STAGE)).alias("stage"))


_CATEGORY = "CASE event_type WHEN 'view' THEN 'urgency' WHEN 'error' THEN ' FEAR' ELSE event_type END"


@check("v03_category_quarantine", f"""SELECT upper(trim({_CATEGORY})) IN {sql_in(v.CATEGORIES)} AS kept, count(*) AS n FROM events GROUP BY ALL""")
def v03(spark, d):
    good, bad = V.quarantine_categories(table(spark, d, "events").withColumn("category", F.expr(_CATEGORY)))
    return good.agg(F.count("*").alias("n")).select(F.lit(True).alias("kept"), "n").unionByName(
        bad.agg(F.count("*").alias("n")).select(F.lit(False).alias("kept"), "n"))


@check("v04_range_checks", """SELECT event_id, CASE WHEN user_id - 10 < 0 THEN 'index below 0' WHEN value - 5 < 0 THEN 'start below 0'
    WHEN value - 3 < 0 THEN 'end below 0' WHEN value / 10 > 1 THEN 'confidence out of range'
    WHEN event_type NOT IN ('view', 'click') THEN 'unknown speaker' END AS violation FROM events
    WHERE user_id - 10 < 0 OR value - 5 < 0 OR value - 3 < 0 OR value / 10 > 1 OR event_type NOT IN ('view', 'click')""")
def v04(spark, d):
    df = table(spark, d, "events").select(
        "event_id", (F.col("user_id") - 10).alias("seq"), (F.col("value") - 5).alias("start"), (F.col("value") - 3).alias("end"),
        (F.col("value") / 10).alias("confidence"),
        F.when(F.col("event_type").isin("view", "click"), "CALLER").otherwise("OTHER").alias("speaker"))
    return V.segment_violations(df).select("event_id", "violation")


@check("v04_end_repair", """SELECT event_id, greatest(value, 10.0::DOUBLE) AS "end" FROM events""")
def v04b(spark, d):
    df = table(spark, d, "events").select(
        "event_id", F.lit(10.0).alias("start"), F.col("value").alias("end"), F.lit("a").alias("text"), F.lit("").alias("text_original"))
    return V.repair_segments(df).select("event_id", "end")


@check("v05_unique_key", """SELECT user_id AS call_id, minute(ts)::BIGINT AS seq, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1""")
def v05(spark, d):
    df = table(spark, d, "events").select(F.col("user_id").alias("call_id"), F.minute("ts").cast("bigint").alias("seq"))
    return V.duplicate_keys(df)
