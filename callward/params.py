"""Caller-replaceable parameters: the lexicon, rule tables and small dimension tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from callward import vocab
from callward.functions.text import ActMarkers, canon_text

MAX_LEXICON_ROWS = 50_000
OPEN = "[^ ]*"  # the rest of a word
PLAIN_STEMS = 16  # a concept of more stems is one pattern


def stem_pattern(stem: str, exact: bool) -> str | None:
    """Pattern of one stem against padded canonical text (words between single spaces).

    Tokens of four letters or more, and the last token of a phrase, match as word
    prefixes; shorter tokens match whole words.
    """
    toks = canon_text(stem).split()
    if not toks:
        return None
    last = len(toks) - 1
    out = []
    for i, tok in enumerate(toks):
        open_ended = not exact and (len(tok) >= 4 or (i == last and last > 0))
        out.append(tok + (OPEN if open_ended else ""))
    closed = "" if out[last].endswith(OPEN) else " "
    return " ".join(out) + closed


@dataclass(frozen=True)
class Lexicon:
    """Ordered (concept, stem) pairs; the first matching stem of a concept is reported."""

    entries: tuple[tuple[str, str], ...]
    otp_password_phrase: str = vocab.OTP_PASSWORD_PHRASE

    @classmethod
    def of(cls, stems: dict[str, tuple[str, ...]], **kw) -> "Lexicon":
        return cls(tuple((c, s) for c, group in stems.items() for s in group), **kw)

    @classmethod
    def from_table(cls, table: DataFrame, **kw) -> "Lexicon":
        """Read (concept, stem, ord).  A lexicon is a small parameter; its size is checked."""
        rows = table.select("concept", "stem", "ord").limit(MAX_LEXICON_ROWS + 1).collect()
        if len(rows) > MAX_LEXICON_ROWS:
            raise ValueError(f"lexicon has more than {MAX_LEXICON_ROWS} stems")
        unknown = {r.concept for r in rows} - set(vocab.CONCEPTS)
        if unknown:
            raise ValueError(f"unknown concepts: {sorted(unknown)}")
        rows.sort(key=lambda r: (r.concept, r.ord))
        return cls(tuple((r.concept, r.stem) for r in rows), **kw)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, s, i) for i, (c, s) in enumerate(self.entries)]
        return spark.createDataFrame(rows, "concept string, stem string, ord int")

    @cached_property
    def stems(self) -> dict[str, list[tuple[str, str]]]:
        """concept -> [(stem, pattern without the leading space)]"""
        out: dict[str, list[tuple[str, str]]] = {}
        for concept, stem in self.entries:
            pattern = stem_pattern(stem, concept in vocab.EXACT_CONCEPTS)
            if pattern:
                out.setdefault(concept, []).append((stem, pattern))
        return out

    def pattern(self, concept: str) -> str | None:
        group = self.stems.get(concept)
        return " (?:" + "|".join(p for _, p in group) + ")" if group else None

    def test_sql(self, concept: str, padded: str) -> str | None:
        """SQL for "`pattern` occurs in `padded`"; stems that are plain text are looked for without a pattern."""
        group = [p for _, p in self.stems.get(concept, ())]
        if not group:
            return None
        if len(group) > PLAIN_STEMS:
            return f"{padded} RLIKE '{self.pattern(concept)}'"
        tests = []
        for p in dict.fromkeys(group):
            text = p.removesuffix(OPEN)
            begins = f"contains({padded}, ' {text.split(OPEN)[0]}')"
            tests.append(begins if OPEN not in text else f"({begins} AND {padded} RLIKE ' {p}')")
        return "(" + " OR ".join(tests) + ")"

    def protected_stems(self) -> tuple[str, ...]:
        found = {canon_text(s) for c, s in self.entries if c in vocab.PROTECTED_CONCEPTS}
        return tuple(sorted(found - {""}, key=lambda s: (-len(s), s)))


#: A starter lexicon in English.  Production lexicons are tables (`Lexicon.from_table`).
ENGLISH_STEMS = {
    "ORG_BANK": ("bank", "credit union"),
    "ORG_POLICE": ("police", "constable"),
    "ORG_INVESTIGATOR": ("investigator", "prosecutor", "detective"),
    "ORG_GOVERNMENT": ("tax office", "ministry", "social security"),
    "ORG_TELCO": ("phone company", "mobile operator"),
    "ORG_DELIVERY": ("courier", "parcel"),
    "ORG_MARKETPLACE": ("marketplace", "classified ad"),
    "ORG_CRYPTO": ("crypto", "bitcoin"),
    "ORG_INVESTMENT": ("broker", "investment"),
    "ORG_EMPLOYER": ("recruiter", "vacancy"),
    "SECURITY_DEPT": ("security department", "fraud team"),
    "SELF_INTRO": ("my name is", "i am calling from", "this is"),
    "ROLE_CLAIM": ("i work for", "specialist", "support agent"),
    "PROBLEM_LOAN": ("loan in your name", "credit application"),
    "PROBLEM_TRANSACTION": ("suspicious transaction", "unauthorised payment"),
    "PROBLEM_BLOCKED": ("blocked", "suspended"),
    "PROBLEM_COMPROMISE": ("hacked", "data leak"),
    "PROBLEM_LEGAL": ("criminal case", "unpaid fine"),
    "PROBLEM_REFUND": ("refund", "compensation"),
    "URGENCY": ("urgent", "right now", "immediately"),
    "THREAT": ("arrest", "you will lose", "lawsuit"),
    "FEAR": ("in danger", "scammers", "at risk"),
    "SECRECY": ("keep this secret", "confidential", "tell nobody"),
    "ISOLATION": ("stay on the line", "do not hang up", "do not call the bank"),
    "SOLUTION_FRAME": ("to cancel", "to protect", "only way"),
    "TRUST_FRAME": ("trust me", "do not worry"),
    "REWARD_FRAME": ("guaranteed income", "bonus", "prize"),
    "TARGET_OTP": ("one time code", "code from the sms", "verification code"),
    "TARGET_CODE_GENERIC": ("code",),
    "TARGET_CODE_WORD": ("code word", "secret word"),
    "TARGET_CARD_FULL": ("card number", "cvv", "expiry date"),
    "TARGET_CARD_PARTIAL": ("last four digits",),
    "TARGET_PASSWORD": ("password", "login", "pin"),
    "TARGET_PERSONAL_DATA": ("passport", "date of birth", "id number"),
    "TARGET_MONEY": ("transfer", "deposit", "money"),
    "TARGET_SAFE_ACCOUNT": ("safe account", "reserve account"),
    "TARGET_CASH_POINT": ("cash machine", "atm"),
    "TARGET_REMOTE_APP": ("anydesk", "teamviewer"),
    "TARGET_REMOTE_ACCESS": ("remote access", "connect to your phone"),
    "TARGET_SCREEN": ("share your screen", "show your screen"),
    "TARGET_APP_INSTALL": ("install the app", "download the app"),
    "TARGET_LINK": ("link", "website"),
    "TARGET_CRYPTO": ("crypto wallet", "bitcoin"),
    "OFFICIAL_CHANNEL": ("number on the back", "official number", "visit a branch"),
    "NEVER_ASKS": ("never ask", "will not ask"),
    "WARNING_FRAME": ("if someone asks", "if anyone calls"),
    "CUSTOMER_INQUIRY": ("i wanted to ask", "my question"),
    "VICTIM_REFUSAL": ("i will not", "i refuse"),
    "VICTIM_COMPLIANCE": ("i am sending", "here it is", "i transferred"),
    "VICTIM_DOUBT": ("i did not order", "strange", "who are you"),
}
ENGLISH = Lexicon.of(ENGLISH_STEMS, otp_password_phrase="password from the sms")
ENGLISH_MARKERS = ActMarkers(
    negated=("no need", "not required"),
    requests=("tell me", "read me", "give me", "send me", "please transfer", "transfer the",
              "please install", "you must", "you need to"),
    prohibitions=("do not tell", "do not share", "never tell", "never share", "do not give"),
    questions=("how", "why", "when", "which", "where", "who", "what"),
    negative_imperative=None,
)
ENGLISH_CONJUNCTIONS = ("and", "but", "then", "so")


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """Rule constants as small tables, for joins and for editing."""
    if name == "rules":
        rows = [(c, w, next((g for g, m in vocab.GROUPS.items() if c in m), None))
                for c, w in vocab.WEIGHTS.items()]
        return spark.createDataFrame(rows, "category string, weight double, grp string")
    if name == "severity":
        rows = [(s, vocab.SEVERITY_MULTIPLIER[s], i) for i, s in enumerate(vocab.SEVERITIES)]
        return spark.createDataFrame(rows, "severity string, multiplier double, sev int")
    if name == "caps":
        return spark.createDataFrame(list(vocab.GROUP_CAPS.items()), "grp string, cap double")
    if name == "bands":
        return spark.createDataFrame(list(vocab.BANDS), "lo int, hi int, level string")
    if name == "stages":
        return spark.createDataFrame(list(vocab.STAGE_DEPTH.items()), "stage string, depth int")
    if name == "category_map":
        rows = [(c, vocab.CATEGORY_STAGE.get(c), vocab.CATEGORY_TACTIC.get(c), c in vocab.HARMFUL,
                 c in vocab.PRESSURE, c in vocab.CALLER_ONLY) for c in vocab.CATEGORIES]
        return spark.createDataFrame(
            rows, "category string, stage string, tactic string, harmful boolean, "
            "pressure boolean, caller_only boolean")
    if name == "interactions":
        rows = [("group", *r) for r in vocab.GROUP_INTERACTIONS]
        rows += [("category", *r) for r in vocab.CATEGORY_INTERACTIONS]
        return spark.createDataFrame(rows, "kind string, a string, b string, points double")
    raise KeyError(name)
