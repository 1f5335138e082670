"""Shared inputs of the check queries: tables, prose parameters, SQL fragments.

The test prose is invented, so the queries pass a lexicon and marker lists made of
its frequent words.  Roles map to speakers; direction and confidence are derived
from each conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callward import vocab
from callward.functions.text import ActMarkers, LanguagePair
from callward.operators import segments as S
from callward.params import Lexicon

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with its SQL twin if there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- parameters for the invented prose ------------------------------------------

PROSE = Lexicon.of({
    "ORG_BANK": ("thing", "keiten"), "ORG_POLICE": ("thou",), "ORG_INVESTIGATOR": ("erin",),
    "ORG_GOVERNMENT": ("sich",), "ORG_TELCO": ("onti",), "ORG_DELIVERY": ("erha",),
    "ORG_MARKETPLACE": ("onnd",), "ORG_CRYPTO": ("reea",), "ORG_INVESTMENT": ("onor",),
    "ORG_EMPLOYER": ("onin",), "SECURITY_DEPT": ("erth", "für"),
    "SELF_INTRO": ("this", "das", "que"), "ROLE_CLAIM": ("that", "von"),
    "PROBLEM_LOAN": ("thre",), "PROBLEM_TRANSACTION": ("thon", "auf"), "PROBLEM_BLOCKED": ("erer",),
    "PROBLEM_COMPROMISE": ("onan",), "PROBLEM_LEGAL": ("erst",), "PROBLEM_REFUND": ("ered",),
    "URGENCY": ("with the", "des", "thes"), "THREAT": ("therth", "losi", "eauqu"), "FEAR": ("fromth", "from the", "mit der"),
    "SECRECY": ("thinth", "unre", "aufs"), "ISOLATION": ("theath", "zube"), "SOLUTION_FRAME": ("are", "les"),
    "TRUST_FRAME": ("than",), "REWARD_FRAME": ("thor", "le"),
    "TARGET_OTP": ("of the", "de la", "the and"), "TARGET_CODE_GENERIC": ("the", "der", "thing"),
    "TARGET_CODE_WORD": ("to the", "der und"), "TARGET_CARD_FULL": ("in the", "inthe"),
    "TARGET_CARD_PARTIAL": ("on", "im"), "TARGET_PASSWORD": ("ththre", "dench", "enre"),
    "TARGET_PERSONAL_DATA": ("at", "et"), "TARGET_MONEY": ("by", "la"),
    "TARGET_SAFE_ACCOUNT": ("erouth", "enenst"), "TARGET_CASH_POINT": ("an", "el"),
    "TARGET_REMOTE_APP": ("erlyre",), "TARGET_REMOTE_ACCESS": ("anreth",), "TARGET_SCREEN": ("thedre", "aipa"),
    "TARGET_APP_INSTALL": ("as", "en"), "TARGET_LINK": ("be",), "TARGET_CRYPTO": ("or", "es"),
    "OFFICIAL_CHANNEL": ("onwh", "hewh"), "NEVER_ASKS": ("onou",), "WARNING_FRAME": ("erat",),
    "CUSTOMER_INQUIRY": ("erea", "nicht"), "VICTIM_REFUSAL": ("onre",),
    "VICTIM_COMPLIANCE": ("thti", "por"), "VICTIM_DOUBT": ("thnd", "une"),
}, otp_password_phrase="thth")
MARKERS = ActMarkers(
    negated=("anti", "ung der"), requests=("reti", "heit er", "eauai", "shed", "cióna"),
    prohibitions=("hast", "nicht", "ndst", "que la"), questions=("that", "die", "est"),
    negative_imperative=" [^ ]{5,}(?:ble|ich) ",
)
CONJUNCTIONS = ("and", "und", "et", "the", "la")
LANGS = LanguagePair(
    first="de", first_letters="äöüß", first_words=("der", "die", "und", "in", "den", "von", "zu"),
    first_suffixes=("ung", "keit", "heit", "lich"), second="en",
    second_words=("the", "of", "and", "to", "is", "that"), second_letters="a-m",
)


# --- Spark inputs ------------------------------------------------------------------

def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations")
    speaker = F.when(F.col("role") == "user", "VICTIM").when(F.col("role") == "assistant", "CALLER").otherwise("UNKNOWN")
    opener = df.groupBy("conv_id").agg(F.min_by("role", "turn").alias("opener"))
    direction = F.when(F.col("opener") == "user", "inbound").when(F.col("opener") == "assistant", "outbound").otherwise("unknown")
    return df.join(opener, "conv_id").select(
        F.col("conv_id").alias("call_id"), "turn", speaker.alias("speaker"), "text",
        (0.3703 + (F.length("text") % 61) / 97.0).alias("confidence"), direction.alias("call_direction"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_turns(turns(spark, sf_dir), clean=False, pair=LANGS)


# --- SQL fragments -----------------------------------------------------------------

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_canon(x: str) -> str:
    return rf"trim(regexp_replace(translate(lower({x}), 'ё', 'е'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def sql_quote_canon(x: str) -> str:
    return rf"trim(regexp_replace(translate(lower({x}), 'ё', 'е'), '[^\p{{L}}\p{{N}}_Ѐ-ӿ]+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda t: t <> '')"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({sql_canon(x)}, ' '), lambda t: t <> '')"


def sql_ts(x: str) -> str:
    s = f"cast(floor(greatest({x}, 0)) AS BIGINT)"
    return f"format('{{:02d}}:{{:02d}}', {s} // 60, {s} % 60)"


def sql_in(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def sql_clauses(x: str) -> str:
    """List of clauses: mark the comma before a conjunction, then split."""
    lead = "|".join(f"{c} " for c in CONJUNCTIONS)
    marked = rf"regexp_replace({x}, ',{SPACE}+((?:{lead}))', chr(1) || '\1', 'g')"
    return (f"list_filter(list_transform(string_split_regex({marked}, '[.!?;\\n]+|\\x01'), "
            f"lambda p: {sql_strip('p')}), lambda p: p <> '')")


def sql_act(padded: str) -> str:
    def contains(markers) -> str:
        return "(" + " OR ".join(f"contains(trim({padded}), {quote(m)})" for m in markers) + ")"

    starts = " OR ".join(f"starts_with({padded}, {quote(' ' + q)})" for q in MARKERS.questions)
    return (f"CASE WHEN {contains(MARKERS.negated)} THEN 'PROHIBITION' "
            f"WHEN {contains(MARKERS.requests)} THEN 'REQUEST' "
            f"WHEN {contains(MARKERS.prohibitions)} OR list_bool_or(list_transform(string_split(trim({padded}), ' '), "
            f"lambda t: length(t) >= 8 AND (ends_with(t, 'ble') OR ends_with(t, 'ich')))) THEN 'PROHIBITION' "
            f"WHEN {starts} THEN 'QUESTION' ELSE 'STATEMENT' END")


def sql_case(column: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {default} END"


def sql_values(rows, name: str, cols: str) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


LEX_ROWS = [(c, s, p, i, vocab.bit(c)) for i, (c, s, p) in enumerate(
    (c, s, p) for c, group in PROSE.stems.items() for s, p in group)]
SQL_LEX = sql_values([(c, s, " " + p, i, b) for c, s, p, i, b in LEX_ROWS], "lex", "concept, stem, pat, ord, bit")

SQL_TURNS = """
turns AS (
  SELECT conv_id AS call_id, turn,
    CASE role WHEN 'user' THEN 'VICTIM' WHEN 'assistant' THEN 'CALLER' ELSE 'UNKNOWN' END AS speaker,
    text, 0.3703::DOUBLE + (length(text) % 61)::DOUBLE / 97.0::DOUBLE AS confidence,
    CASE first_value(role) OVER (PARTITION BY conv_id ORDER BY turn)
      WHEN 'user' THEN 'inbound' WHEN 'assistant' THEN 'outbound' ELSE 'unknown' END AS call_direction
  FROM conversations)
"""

SQL_SEGMENTS = SQL_TURNS + f""",
seg0 AS (
  SELECT *, {sql_strip('text')} AS body FROM turns WHERE {sql_strip('text')} <> ''),
seg1 AS (
  SELECT *, greatest(2.0::DOUBLE, least(9.0::DOUBLE, length(body)::DOUBLE / 14)) AS d FROM seg0),
seg AS (
  SELECT call_id, row_number() OVER w - 1 AS seq, speaker, body AS text, confidence, call_direction, d,
    1.5::DOUBLE + coalesce(sum(greatest(6.0::DOUBLE, d + 0.6::DOUBLE)) OVER (
      PARTITION BY call_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM seg1 WINDOW w AS (PARTITION BY call_id ORDER BY turn))
"""

SQL_CLAUSES = SQL_SEGMENTS + f""",
{SQL_LEX},
cl0 AS (SELECT call_id, seq, speaker, start, text, {sql_clauses('text')} AS p0 FROM seg),
cl1 AS (SELECT * EXCLUDE (p0), CASE WHEN len(p0) > 0 THEN p0 ELSE [text] END AS p FROM cl0),
cl2 AS (SELECT call_id, seq, speaker, start, unnest(p) AS evidence, generate_subscripts(p, 1) - 1 AS clause_ix FROM cl1),
cl3 AS (SELECT *, ' ' || {sql_canon('evidence')} || ' ' AS padded FROM cl2),
hit AS (SELECT c.call_id, c.seq, c.clause_ix, l.concept, l.stem, l.ord, l.bit
  FROM cl3 c JOIN lex l ON regexp_matches(c.padded, l.pat)),
msk AS (SELECT call_id, seq, clause_ix, bit_or(bit::BIGINT) AS raw FROM hit GROUP BY ALL),
cl4 AS (SELECT c.*, coalesce(m.raw, 0) AS raw, {sql_act('c.padded')} AS act
  FROM cl3 c LEFT JOIN msk m USING (call_id, seq, clause_ix)),
cl5 AS (SELECT *, raw
    & ~(CASE WHEN raw & {vocab.bit('TARGET_OTP')} <> 0 THEN {vocab.bit('TARGET_CODE_GENERIC')}::BIGINT ELSE 0 END)
    & ~(CASE WHEN raw & {vocab.bit('TARGET_CARD_FULL')} <> 0 THEN {vocab.bit('TARGET_CARD_PARTIAL')}::BIGINT ELSE 0 END)
    & ~(CASE WHEN raw & {vocab.bit('TARGET_OTP')} <> 0 AND contains(padded, {quote(PROSE.otp_password_phrase)})
        THEN {vocab.bit('TARGET_PASSWORD')}::BIGINT ELSE 0 END) AS mask
  FROM cl4),
clause AS (SELECT *, coalesce(bit_or(mask) OVER (PARTITION BY call_id, seq ORDER BY clause_ix
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
    row_number() OVER (PARTITION BY call_id ORDER BY seq, clause_ix) AS k
  FROM cl5)
"""


def b(*concepts: str, col: str = "mask") -> str:
    """SQL test: the concept set holds one of these."""
    return f"({col} & {vocab.bits(*concepts)}) <> 0"
