"""The whole call analysis as SQL, written the other way round.

The running context is a recursive fold over the clauses of a call, label sets are
lists, and the score multiplies component rows, so agreement with the Spark plan
is not agreement of one formula with itself.
"""

from __future__ import annotations

from callward import vocab as v
from callward.operators.verdict import ACTION_TEXT
from checks.common import SQL_CLAUSES, SQL_SEGMENTS, b, quote, sql_case, sql_in, sql_quote_canon, sql_ts

PROBLEMS = v.bits(*v.PROBLEM_CONCEPTS)
ACTIVE = "(c.caller AND NOT c.official AND NOT (c.forbids AND c.scope AND NOT f.dm))"

SQL_CONTEXT = SQL_CLAUSES + f""",
flag AS (SELECT *, speaker = 'CALLER' AS caller, act = 'REQUEST' AS asks, act = 'PROHIBITION' AS forbids,
    act = 'STATEMENT' AS states, {b(*v.OFFICIAL_CONCEPTS)} AS official,
    ({b(*v.CREDENTIAL_TARGETS)} OR {b(*v.CREDENTIAL_TARGETS, col='prior')} OR {b('NEVER_ASKS', col='prior')}) AS scope,
    ({b('TARGET_OTP')} OR ({b('TARGET_OTP', col='prior')} AND act = 'REQUEST')) AND NOT {b('TARGET_CODE_WORD')} AS otp,
    {b('TARGET_CODE_GENERIC')} AND NOT {b('TARGET_CODE_WORD')} AS generic,
    {b('TARGET_CODE_WORD')} AS code_word, {b('TARGET_CARD_FULL')} AS card, {b('TARGET_PASSWORD')} AS pwd
  FROM clause),
fold AS (
  SELECT DISTINCT call_id, 0::BIGINT AS k, 0::BIGINT AS vp, 0::BIGINT AS cp, false AS an, false AS dm FROM flag
  UNION ALL
  SELECT f.call_id, c.k,
    CASE WHEN c.speaker = 'VICTIM' THEN f.vp | (c.mask & {PROBLEMS}) ELSE f.vp END,
    CASE WHEN {ACTIVE} THEN f.cp | (c.mask & {PROBLEMS} & ~f.vp) ELSE f.cp END,
    f.an OR ({ACTIVE} AND c.otp AND NOT c.asks),
    f.dm OR ({ACTIVE} AND ((c.asks AND (c.otp OR c.generic OR c.card OR c.pwd))
                           OR (c.states AND f.cp <> 0 AND (c.card OR c.pwd))))
  FROM fold f JOIN flag c ON c.call_id = f.call_id AND c.k = f.k + 1),
ctx AS (SELECT c.*, f.vp, f.cp, f.an, f.dm, {ACTIVE} AS active,
    CASE WHEN {ACTIVE} THEN c.mask & {PROBLEMS} & ~f.vp ELSE 0 END AS problems,
    CASE WHEN c.caller THEN (c.official OR (c.forbids AND c.scope AND NOT f.dm))::INT
         WHEN c.speaker = 'VICTIM' THEN (c.forbids AND ({b(*v.CREDENTIAL_TARGETS, col='c.mask')}
              OR {b(*v.CREDENTIAL_TARGETS, col='c.prior')}))::INT + (c.official OR {b('VICTIM_REFUSAL', col='c.mask')})::INT
         ELSE c.official::INT END AS protective,
    cast(floor(greatest(c.start, 0)) AS BIGINT) AS sec
  FROM flag c JOIN fold f ON f.call_id = c.call_id AND f.k = c.k - 1)
"""

_RULES = [
    ("OTP_REQUEST", "otp AND asks", "'CRITICAL'"),
    ("OTP_REQUEST", "NOT otp AND generic AND asks", "CASE WHEN an OR cp <> 0 THEN 'CRITICAL' ELSE 'HIGH' END"),
    ("PERSONAL_DATA_REQUEST", "code_word AND asks", "'LOW'"),
    ("CARD_REQUEST", "card AND asks", "'CRITICAL'"),
    ("PERSONAL_DATA_REQUEST", f"{b('TARGET_CARD_PARTIAL')} AND NOT card AND asks", "'LOW'"),
    ("PASSWORD_REQUEST", "pwd AND asks", "'CRITICAL'"),
    ("PASSWORD_REQUEST", "pwd AND NOT asks AND cp <> 0 AND states", "'HIGH'"),
    ("CARD_REQUEST", "card AND NOT asks AND cp <> 0 AND states", "'HIGH'"),
    ("PERSONAL_DATA_REQUEST", f"{b('TARGET_PERSONAL_DATA')} AND asks", "'MEDIUM'"),
    ("SAFE_ACCOUNT", b("TARGET_SAFE_ACCOUNT"), "'CRITICAL'"),
    ("MONEY_TRANSFER", f"NOT {b('TARGET_SAFE_ACCOUNT')} AND {b('TARGET_MONEY')} AND asks",
     f"CASE WHEN {b('TARGET_CASH_POINT')} THEN 'CRITICAL' ELSE 'HIGH' END"),
    ("CRYPTO_TRANSFER", f"{b('TARGET_CRYPTO')} AND (asks OR {b('TARGET_MONEY')})", "'HIGH'"),
    ("REMOTE_ACCESS", f"({b('TARGET_REMOTE_APP')} OR {b('TARGET_REMOTE_ACCESS')})", "'CRITICAL'"),
    ("SCREEN_SHARING", f"{b('TARGET_SCREEN')} AND (asks OR states)", "'HIGH'"),
    ("APP_INSTALLATION", f"{b('TARGET_APP_INSTALL')} AND asks", "'HIGH'"),
    ("THREAT", b("THREAT"), "'HIGH'"),
    ("FEAR", f"NOT {b('THREAT')} AND {b('FEAR')}", "'MEDIUM'"),
    ("URGENCY", b("URGENCY"), "CASE WHEN cp <> 0 THEN 'MEDIUM' ELSE 'LOW' END"),
    ("SECRECY", b("SECRECY"), "'HIGH'"),
    ("ISOLATION", b("ISOLATION"), "'HIGH'"),
]
_SEV = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
_RULE_SQL = "\nUNION ALL ".join(
    f"SELECT call_id, k, seq, sec, speaker, evidence, {i} AS rule, '{cat}' AS category, {sev} AS severity "
    f"FROM ctx WHERE active AND {cond}" for i, (cat, cond, sev) in enumerate(_RULES))

SQL_EVENTS = SQL_CONTEXT + f""",
ev0 AS ({_RULE_SQL}),
ev AS (SELECT * FROM ev0 QUALIFY row_number() OVER (PARTITION BY call_id, category, sec
    ORDER BY {sql_case('severity', _SEV)} DESC, k, rule) = 1)
"""

_KINDS = {
    "identity": f"active AND (({b(*v.ORG_CONCEPTS)} AND {b('SELF_INTRO', 'ROLE_CLAIM', 'SECURITY_DEPT')}) "
                f"OR ({b('ROLE_CLAIM', 'SECURITY_DEPT')} AND {b('SELF_INTRO')}))",
    "problem": "problems <> 0",
    "solution": f"active AND {b('SOLUTION_FRAME')}",
    "reward": f"active AND {b('REWARD_FRAME')}",
    "protective": "protective > 0",
    "compliance": f"speaker = 'VICTIM' AND {b('VICTIM_COMPLIANCE')}",
    "doubt": f"speaker = 'VICTIM' AND {b('VICTIM_DOUBT')}",
    "inquiry": f"speaker = 'VICTIM' AND {b('CUSTOMER_INQUIRY')}",
}
KIND_COLUMNS = ", ".join(f"min(CASE WHEN {c} THEN k END) AS {k}_k" for k, c in _KINDS.items())


def sql_list(values) -> str:
    return "[" + ", ".join(quote(x) for x in values) + "]"


HARM, PRESS = sql_list(v.HARMFUL), sql_list(v.PRESSURE)
PRESS_ONLY = sql_list(c for c in v.PRESSURE if c not in ("FALSE_PROBLEM", "FALSE_SOLUTION"))
_OPT = "CASE WHEN {c} THEN ['{v}'] ELSE [] END"


def _concat(items) -> str:
    return "flatten([" + ", ".join(_OPT.format(c=c, v=x) for c, x in items) + "])"


def _cat(*labels: str) -> str:
    return f"len(list_intersect(cats, {sql_list(labels)})) > 0"


def _org(*c: str) -> str:
    return b(*c, col="orgs")


def _prob(*c: str) -> str:
    return b(*c, col="cproblems")


_SCAM = [
    (f"{_cat('IMPERSONATION')} AND {_org('SECURITY_DEPT', 'ORG_BANK')}", "BANK_IMPERSONATION"),
    (f"{_cat('IMPERSONATION')} AND {_org('ORG_POLICE')}", "POLICE_IMPERSONATION"),
    (f"{_cat('IMPERSONATION')} AND {_org('ORG_INVESTIGATOR')}", "INVESTIGATOR_IMPERSONATION"),
    (f"{_cat('IMPERSONATION')} AND {_org('ORG_GOVERNMENT')}", "GOVERNMENT_IMPERSONATION"),
    (_prob("PROBLEM_LOAN"), "FAKE_LOAN"), (_prob("PROBLEM_TRANSACTION"), "FAKE_TRANSACTION"),
    (_prob("PROBLEM_COMPROMISE", "PROBLEM_BLOCKED"), "ACCOUNT_COMPROMISE"), (_prob("PROBLEM_REFUND"), "FAKE_REFUND"),
    (_cat("OTP_REQUEST"), "OTP_THEFT"), (_cat("CARD_REQUEST"), "CARD_DATA_THEFT"),
    (_cat("PASSWORD_REQUEST"), "CREDENTIAL_THEFT"), (_cat("SAFE_ACCOUNT"), "SAFE_ACCOUNT_SCAM"),
    (_cat("MONEY_TRANSFER"), "MONEY_TRANSFER_SCAM"), (_cat(*v.DEVICE), "REMOTE_ACCESS_SCAM"),
    (f"{_cat('CRYPTO_TRANSFER')} OR {_org('ORG_CRYPTO')}", "CRYPTO_SCAM"),
    (f"{_org('ORG_INVESTMENT')} AND reward_k IS NOT NULL", "INVESTMENT_SCAM"),
    (_org("ORG_DELIVERY"), "DELIVERY_SCAM"), (_org("ORG_MARKETPLACE"), "MARKETPLACE_SCAM"),
    (f"{_org('ORG_EMPLOYER')} AND reward_k IS NOT NULL", "JOB_SCAM"),
]

DEPTH_NAME = "CASE depth " + " ".join(f"WHEN {d} THEN '{s}'" for s, d in v.STAGE_DEPTH.items()) + " END"

SQL_VERDICT = SQL_EVENTS + f""",
kinds AS (SELECT call_id, {KIND_COLUMNS},
    bit_or(CASE WHEN active THEN mask & {v.bits(*v.ORG_CONCEPTS)} ELSE 0 END) AS orgs,
    bit_or(problems) AS cproblems FROM ctx GROUP BY call_id),
facts0 AS (SELECT call_id, count(*) AS n_segments, avg(confidence) AS mean_confidence, max(start + d) AS duration,
    max(call_direction) AS call_direction FROM seg GROUP BY call_id),
base AS (SELECT call_id, list_distinct(list(category)) AS cats0, count(*) AS n0,
    count(*) FILTER (severity = 'CRITICAL') AS n_critical FROM ev GROUP BY call_id),
s1 AS (SELECT f.*, k.* EXCLUDE (call_id), coalesce(cats0, []) AS cats0, coalesce(n0, 0) AS n0,
    coalesce(n_critical, 0) AS n_critical
  FROM facts0 f LEFT JOIN kinds k USING (call_id) LEFT JOIN base USING (call_id)),
s2 AS (SELECT *, len(list_intersect(cats0, {HARM})) > 0 AS payoff,
    len(list_intersect(cats0, {HARM})) > 0 OR len(list_intersect(cats0, {PRESS})) >= 2 AS attack FROM s1),
s3 AS (SELECT *, attack AND identity_k IS NOT NULL AS f_imp, attack AND problem_k IS NOT NULL AS f_prob,
    attack AND problem_k IS NOT NULL AND solution_k IS NOT NULL AS f_sol FROM s2),
s4 AS (SELECT *, list_concat(cats0, {_concat([('f_imp', 'IMPERSONATION'), ('f_prob', 'FALSE_PROBLEM'), ('f_sol', 'FALSE_SOLUTION')])}) AS cats,
    n0 + f_imp::INT + f_prob::INT + f_sol::INT AS n_events FROM s3),
s5 AS (SELECT *, identity_k IS NOT NULL AS l_identity, f_prob AS l_problem, f_sol AS l_solution,
    len(list_intersect(cats, {PRESS_ONLY})) > 0 AS l_pressure, len(list_intersect(cats, {PRESS})) AS n_pressure FROM s4),
s6 AS (SELECT *, l_identity::INT + l_problem::INT + l_pressure::INT + l_solution::INT + payoff::INT AS n_links,
    l_identity OR l_problem OR l_solution OR n_pressure >= 2 AS framed,
    (len(list_intersect(cats, {sql_list(v.CREDENTIAL)})) > 0)::INT + (len(list_intersect(cats, {sql_list(v.MONEY)})) > 0)::INT
      + (len(list_intersect(cats, {sql_list(v.DEVICE)})) > 0)::INT AS families FROM s5),
s7 AS (SELECT *, CASE WHEN payoff AND framed THEN 'SCAM'
    WHEN payoff AND (families >= 2 OR list_contains(cats, 'SAFE_ACCOUNT')) THEN 'SCAM'
    WHEN payoff THEN 'SUSPICIOUS'
    WHEN call_direction = 'inbound' OR inquiry_k IS NOT NULL THEN 'SAFE'
    WHEN l_problem AND l_pressure THEN 'SUSPICIOUS' WHEN n_pressure >= 3 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS classification FROM s6),
s8 AS (SELECT *, CASE classification
      WHEN 'SCAM' THEN 0.62::DOUBLE + 0.06::DOUBLE * n_links + 0.03::DOUBLE * least(n_critical, 3)
      WHEN 'SUSPICIOUS' THEN 0.42::DOUBLE + 0.05::DOUBLE * n_links ELSE 0.88::DOUBLE - 0.06::DOUBLE * n_events END
      - CASE WHEN mean_confidence < 0.75 THEN 0.08::DOUBLE ELSE 0 END
      - CASE WHEN n_segments < 4 THEN 0.10::DOUBLE ELSE 0 END AS conf0 FROM s7),
framing AS (
  SELECT c.call_id, c.k, c.seq, c.sec, c.speaker, c.evidence, 100 AS rule, x.category,
    CASE WHEN s.payoff AND x.category <> 'FALSE_SOLUTION' THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM s8 s, LATERAL (SELECT unnest([{{'category': 'IMPERSONATION', 'kk': CASE WHEN s.f_imp THEN s.identity_k END}},
    {{'category': 'FALSE_PROBLEM', 'kk': CASE WHEN s.f_prob THEN s.problem_k END}},
    {{'category': 'FALSE_SOLUTION', 'kk': CASE WHEN s.f_sol THEN s.solution_k END}}], recursive := true)) x
  JOIN ctx c ON c.call_id = s.call_id AND c.k = x.kk),
prot0 AS (SELECT call_id, k, seq, sec, speaker, evidence, row_number() OVER (PARTITION BY call_id ORDER BY k, n) AS rn
  FROM (SELECT *, unnest(range(protective)) AS n FROM ctx)),
prot AS (SELECT p.call_id, k, seq, sec, speaker, evidence, 200 AS rule, 'PROTECTIVE_ADVICE' AS category, 'LOW' AS severity
  FROM prot0 p JOIN s8 USING (call_id) WHERE rn <= 3 AND classification = 'SAFE'
  QUALIFY row_number() OVER (PARTITION BY p.call_id, sec ORDER BY k) = 1),
events AS (SELECT * FROM ev UNION ALL SELECT * FROM framing UNION ALL SELECT * FROM prot),
firsts AS (SELECT call_id, category, min(sec) AS sec FROM events GROUP BY ALL),
labels AS (SELECT call_id,
    list_distinct(list({sql_case('category', v.CATEGORY_TACTIC)} ORDER BY sec, category) FILTER ({sql_case('category', v.CATEGORY_TACTIC)} IS NOT NULL)) AS tset,
    list({sql_case('category', v.CATEGORY_TACTIC)} ORDER BY sec, category) FILTER ({sql_case('category', v.CATEGORY_TACTIC)} IS NOT NULL) AS tlist,
    list({sql_case('category', ACTION_TEXT)} ORDER BY sec, category) FILTER ({sql_case('category', ACTION_TEXT)} IS NOT NULL) AS alist,
    max({sql_case(sql_case('category', v.CATEGORY_STAGE), v.STAGE_DEPTH)}) AS depth, count(*) AS shown FROM firsts GROUP BY call_id),
verdict AS (SELECT s.* EXCLUDE (conf0),
    round_even(greatest(0.30::DOUBLE, least(CASE classification WHEN 'SCAM' THEN 0.95::DOUBLE WHEN 'SUSPICIOUS' THEN 0.75::DOUBLE ELSE 0.92::DOUBLE END, conf0)), 2) AS confidence,
    CASE WHEN classification = 'SAFE' THEN [] WHEN len({_concat(_SCAM)}) = 0 THEN ['OTHER_SOCIAL_ENGINEERING'] ELSE {_concat(_SCAM)} END AS scam_types,
    list_concat(list_filter(coalesce(tlist, []), lambda x, i: list_position(tlist, x) = i),
      CASE WHEN f_imp AND {_org('ORG_POLICE', 'ORG_INVESTIGATOR', 'ORG_GOVERNMENT')} THEN ['AUTHORITY'] ELSE [] END) AS tactics,
    list_filter(coalesce(alist, []), lambda x, i: list_position(alist, x) = i) AS requested_actions,
    CASE WHEN shown IS NULL THEN CASE WHEN n_segments <= 4 THEN 'INTRODUCTION' ELSE 'UNKNOWN' END
      WHEN depth = 9 AND compliance_k IS NOT NULL THEN 'PAYMENT'
      ELSE coalesce({DEPTH_NAME}, 'UNKNOWN') END AS stage
  FROM s8 s LEFT JOIN labels USING (call_id))
"""

_GROUP = {c: g for g, members in v.GROUPS.items() for c in members}
SQL_SCORE = SQL_VERDICT + f""",
part AS (SELECT *, CASE WHEN category = 'PROTECTIVE_ADVICE' THEN 'protective'
    WHEN category IN {sql_in(v.CALLER_ONLY)} AND speaker <> 'CALLER' THEN 'not caller' END AS rejected,
    ({sql_case('category', v.WEIGHTS)})::DOUBLE * ({sql_case('severity', v.SEVERITY_MULTIPLIER)})::DOUBLE AS pts,
    {sql_case('category', _GROUP)} AS grp FROM events),
grp AS (SELECT call_id, grp, sum(pts) AS raw, least(sum(pts), {sql_case('grp', v.GROUP_CAPS)}::DOUBLE) AS capped
  FROM part WHERE rejected IS NULL GROUP BY call_id, grp),
present AS (SELECT DISTINCT call_id, category FROM part WHERE rejected IS NULL),
gi(a, b, points) AS (VALUES {", ".join(f"('{a}', '{c}', {p}::DOUBLE)" for a, c, p in v.GROUP_INTERACTIONS)}),
ci(a, b, points) AS (VALUES {", ".join(f"('{a}', '{c}', {p}::DOUBLE)" for a, c, p in v.CATEGORY_INTERACTIONS)}),
inter AS (
  SELECT x.call_id, gi.a || ' + ' || gi.b AS label, gi.points FROM gi JOIN grp x ON x.grp = gi.a AND x.raw > 0
    JOIN grp y ON y.grp = gi.b AND y.call_id = x.call_id AND y.raw > 0
  UNION ALL
  SELECT x.call_id, ci.a || ' + ' || ci.b, ci.points FROM ci JOIN present x ON x.category = ci.a
    JOIN present y ON y.category = ci.b AND y.call_id = x.call_id),
nscored AS (SELECT call_id, count(*) FILTER (rejected IS NULL) AS n_scored, count(*) FILTER (rejected = 'protective') AS n_protective,
    count(*) FILTER (rejected IS NULL AND category IN {sql_in(v.HARMFUL)}) AS n_harm,
    count(*) FILTER (rejected IS NULL AND category IN {sql_in(v.HARMFUL)} AND severity = 'CRITICAL') AS n_crit_harm,
    count(*) FILTER (rejected IS NULL AND category IN {sql_in(v.HARMFUL)} AND severity = 'HIGH') AS n_high_harm,
    count(*) FILTER (rejected IS NULL AND category IN ('IMPERSONATION', 'FALSE_PROBLEM')) AS n_frame
  FROM part GROUP BY call_id),
comp AS (SELECT call_id, capped AS c FROM grp UNION ALL SELECT call_id, points FROM inter
  UNION ALL SELECT call_id, CASE classification WHEN 'SCAM' THEN 12::DOUBLE WHEN 'SUSPICIOUS' THEN 5::DOUBLE ELSE 0 END
    FROM verdict JOIN nscored USING (call_id) WHERE n_scored > 0 AND confidence >= 0.6),
soft AS (SELECT call_id, 100 * (1 - product(1 - greatest(c, 0) / 100)) AS soft FROM comp GROUP BY call_id),
a1 AS (SELECT v.*, coalesce(soft, 0) AS soft, coalesce(n_scored, 0) AS n_scored, coalesce(n_protective, 0) AS n_protective,
    coalesce(n_harm, 0) AS n_harm, coalesce(n_crit_harm, 0) AS n_crit_harm, coalesce(n_high_harm, 0) AS n_high_harm,
    coalesce(n_frame, 0) AS n_frame
  FROM verdict v LEFT JOIN soft USING (call_id) LEFT JOIN nscored USING (call_id)),
a2 AS (SELECT *, CASE WHEN mean_confidence < 0.55 AND soft > 0 THEN soft * 0.85::DOUBLE - soft ELSE 0 END AS dampening,
    CASE WHEN n_harm = 0 AND n_protective > 0 THEN -25::DOUBLE ELSE 0 END AS mit_protective,
    CASE WHEN n_harm = 0 AND call_direction = 'inbound' THEN -12::DOUBLE ELSE 0 END AS mit_inbound,
    CASE WHEN n_crit_harm > 0 AND n_frame > 0 THEN 80 WHEN n_crit_harm > 0 THEN 60
      WHEN n_high_harm > 0 AND n_frame > 0 THEN 60 WHEN n_high_harm > 0 THEN 45 ELSE 0 END AS floor FROM a1),
a3 AS (SELECT *, greatest(0, least(100, soft + dampening + mit_protective + mit_inbound)) AS clamped FROM a2),
a4 AS (SELECT *, cast(round_even(round(greatest(clamped, floor), 9), 0) AS INT) AS risk_score FROM a3),
assessed AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH_RISK'
    WHEN risk_score >= 30 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS risk_level,
    CASE WHEN n_crit_harm > 0 OR risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'WARNING'
      WHEN risk_score >= 30 THEN 'MONITOR' ELSE 'NONE' END AS alert_level,
    CASE WHEN classification = 'SCAM' AND risk_score < 60 THEN 'the verdict says SCAM, the score stays below WARNING'
      WHEN classification = 'SAFE' AND risk_score >= 60 THEN 'the verdict says SAFE, the score reaches WARNING' END AS disagreement FROM a4)
"""


def with_context(select: str) -> str:
    return f"WITH RECURSIVE {SQL_CONTEXT} {select}"


def with_events(select: str) -> str:
    return f"WITH RECURSIVE {SQL_EVENTS} {select}"


def with_verdict(select: str) -> str:
    return f"WITH RECURSIVE {SQL_VERDICT} {select}"


def with_score(select: str) -> str:
    return f"WITH RECURSIVE {SQL_SCORE} {select}"


def timestamp_of(column: str) -> str:
    return sql_ts(column)


def over_windows(size: int, finals: bool) -> str:
    """The whole analysis with every update as a call of its own, {call_id, upd}: the segments up to one, `size` at most.

    With `finals` the whole call comes as one more update, behind the last.
    """
    whole = SQL_SEGMENTS.replace("\nseg AS (", "\nwhole AS (")
    each = f"""SELECT {{'call_id': a.call_id, 'upd': a.seq}} AS call_id, b.* EXCLUDE (call_id) FROM whole a
      JOIN whole b ON a.call_id = b.call_id AND b.seq <= a.seq AND b.seq > a.seq - {size}"""
    if finals:
        each += """ UNION ALL SELECT {'call_id': w.call_id, 'upd': n.n}, w.* EXCLUDE (call_id) FROM whole w
      JOIN (SELECT call_id, count(*) AS n FROM whole GROUP BY 1) n USING (call_id)"""
    return SQL_SCORE.replace(SQL_SEGMENTS, whole + f",\nseg AS ({each})\n")


#: Running values over the updates, for `over_windows`.
SQL_HELD = f""",
u AS (SELECT call_id.call_id AS call_id, call_id.upd AS upd, risk_score, risk_level, classification, stage, tactics, scam_types, {sql_case('stage', v.STAGE_DEPTH)} AS depth
  FROM assessed),
seen AS (SELECT call_id, category, sec, quote, min(upd) AS upd, arg_min(severity, upd) AS severity FROM (
    SELECT call_id.call_id AS call_id, call_id.upd AS upd, category, sec, severity, {sql_quote_canon('evidence')} AS quote FROM events)
  GROUP BY 1, 2, 3, 4),
crit AS (SELECT call_id, category, min(upd) AS upd FROM seen WHERE severity = 'CRITICAL' AND category IN {sql_in(v.HARMFUL)} GROUP BY 1, 2),
held0 AS (SELECT u.*, coalesce(nf.n, 0) AS n_fresh, coalesce(nc.n, 0) AS n_crit,
    CASE WHEN nc.n > 0 THEN 3 WHEN risk_score >= 80 THEN 3 WHEN risk_score >= 60 THEN 2 WHEN risk_score >= 30 THEN 1 ELSE 0 END AS rank,
    lag(stage) OVER (PARTITION BY u.call_id ORDER BY u.upd) AS before
  FROM u LEFT JOIN (SELECT call_id, upd, count(*) AS n FROM seen GROUP BY 1, 2) nf ON nf.call_id = u.call_id AND nf.upd = u.upd
    LEFT JOIN (SELECT call_id, upd, count(*) AS n FROM crit GROUP BY 1, 2) nc ON nc.call_id = u.call_id AND nc.upd = u.upd),
held1 AS (SELECT *, before IS NULL OR before <> stage AS changed FROM held0),
held2 AS (SELECT *, max(risk_score) OVER w AS peak, max(depth) OVER w AS deepest,
    coalesce(max(rank) OVER (PARTITION BY call_id ORDER BY upd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS highest,
    changed AND depth >= coalesce(max(CASE WHEN changed THEN depth END) OVER (PARTITION BY call_id ORDER BY upd
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS entered, row_number() OVER w AS n_updates
  FROM held1 WINDOW w AS (PARTITION BY call_id ORDER BY upd)),
held AS (SELECT *, sum(CASE WHEN n_crit > 0 THEN n_crit WHEN rank > highest THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY upd) AS n_alerts FROM held2),
tac AS (SELECT call_id, label, min([upd, p]) AS spot FROM (SELECT call_id, upd, unnest(tactics) AS label, generate_subscripts(tactics, 1) AS p FROM u) GROUP BY 1, 2),
scam AS (SELECT call_id, label, min([upd, p]) AS spot FROM (SELECT call_id, upd, unnest(scam_types) AS label, generate_subscripts(scam_types, 1) AS p FROM u) GROUP BY 1, 2),
tacs AS (SELECT u.call_id, u.upd, string_agg(label, '|' ORDER BY spot) AS all_tactics FROM u JOIN tac ON tac.call_id = u.call_id AND tac.spot[1] <= u.upd GROUP BY 1, 2),
scams AS (SELECT u.call_id, u.upd, string_agg(label, '|' ORDER BY spot) AS all_scams FROM u JOIN scam ON scam.call_id = u.call_id AND scam.spot[1] <= u.upd GROUP BY 1, 2),
deep AS (SELECT h.*, coalesce(all_tactics, '') AS all_tactics, coalesce(all_scams, '') AS all_scams, {DEPTH_NAME.replace('CASE depth', 'CASE deepest')} AS deepest_stage
  FROM held h LEFT JOIN tacs USING (call_id, upd) LEFT JOIN scams USING (call_id, upd))
"""
