"""DuckDB SQL used as the independent oracle for the registered queries.

DuckDB's dialect differs from Spark's: string literals keep backslashes,
regexes are RE2 (no look-around, ASCII ``\\d``/``\\w``), replacement groups
are ``\\1``, lambdas are ``lambda x: ...`` and lists are 1-based. The answer
functions are therefore written again here, not generated from the Spark
templates. The removal and substitution lists, the white space and the prompt
texts are shared with the Spark side: fixed values, which the tests compare.
"""

from __future__ import annotations

from boxwise.functions.answers import PY_WHITESPACE, REMOVED_EXPRESSIONS, SUBSTITUTIONS

# ---------------------------------------------------------------------------
# Views over the driver tables (FIXTURES.md §2; unchanged text).
# ---------------------------------------------------------------------------
SEEDS = """SELECT o_orderkey AS problem_id,
  concat('Order ', CAST(o_orderkey AS STRING), ' of customer ', CAST(o_custkey AS STRING), '. Find the customer number.') AS problem,
  concat('It is $', chr(92), 'boxed{', CAST(o_custkey AS STRING), '}$.') AS solution,
  CAST(o_custkey AS STRING) AS answer, o_orderpriority AS subject
FROM orders"""

ATTEMPTS = f"""WITH s AS ({SEEDS}),
a AS (SELECT 0 AS attempt UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3),
x AS (SELECT s.problem_id, s.problem, s.answer, a.attempt,
        CAST((s.problem_id + a.attempt) % 10 AS INT) AS form, CAST(s.answer AS BIGINT) AS n
      FROM s CROSS JOIN a)
SELECT problem_id, problem, answer, attempt, CASE form
  WHEN 0 THEN concat('so $', chr(92), 'boxed{{', answer, '}}$.')
  WHEN 1 THEN concat('The answer is: ', answer)
  WHEN 2 THEN concat('The answer is ', answer, '.')
  WHEN 3 THEN concat('thus the answer is ', answer, '.')
  WHEN 4 THEN concat('step 1 gives 17, step 2 gives ', answer)
  WHEN 5 THEN concat(chr(92), 'boxed{{', chr(92), 'frac{{', CAST(2*n AS STRING), '}}{{2}}}}')
  WHEN 6 THEN concat(chr(92), 'boxed{{', chr(92), 'text{{', answer, '}}}}')
  WHEN 7 THEN concat(chr(92), 'boxed{{', CAST(n+1 AS STRING), '}}')
  WHEN 8 THEN concat(chr(92), 'boxed{{1}} then ', chr(92), 'boxed{{x=', answer, ' cm}}')
  ELSE 'I cannot solve it' END AS response
FROM x"""

CANDIDATES = """SELECT o_orderkey AS batch_id, concat_ws(chr(10),
  concat('{"problem": "P', CAST(o_orderkey AS STRING), 'a", "solution": "S", "answer": "', CAST(o_custkey AS STRING), '"}'),
  CASE CAST(o_orderkey % 6 AS INT)
    WHEN 0 THEN concat('{"problem": "Pb", "solution": "S", "answer": ', CAST(o_custkey AS STRING), '}')
    WHEN 1 THEN '{"problem": "Pb", "solution": "S"}'
    WHEN 2 THEN '{"problem": "Pb", '
    WHEN 3 THEN '["Pb"]'
    WHEN 4 THEN '{"problem": "Pb", "solution": "S", "answer": "1"} trailing'
    ELSE '{"problem": "Pb", "answer": "1"}' END) AS content
FROM orders"""

ATTEMPT_LOG = """SELECT concat('u', CAST(user_id AS STRING), '-', CAST(CAST(floor(event_id / 500) AS BIGINT) AS STRING)) AS request_id,
  event_id AS attempt_seq, ts AS attempt_ts,
  CASE event_type WHEN 'purchase' THEN 200 WHEN 'error' THEN 500 WHEN 'signup' THEN 400 WHEN 'click' THEN 429 ELSE NULL END AS status,
  CASE event_type WHEN 'purchase' THEN concat('The answer is: ', CAST(event_id % 7 AS STRING))
    WHEN 'signup' THEN 'error 400 bad request' WHEN 'error' THEN 'server error'
    WHEN 'click' THEN 'too many requests' ELSE NULL END AS body
FROM events"""

SFT_PAIRS = """SELECT conv_id, turn, instruction, output FROM (
  SELECT conv_id, turn, role, text AS output,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS instruction,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev
  FROM conversations) t
WHERE role = 'assistant' AND prev = 'user'"""


def sft_pairs(blank_every: int | None = None) -> str:
    if not blank_every:
        return SFT_PAIRS
    return (f"SELECT conv_id, turn, CASE WHEN conv_id % {blank_every} = 0 THEN '' ELSE instruction END "
            f"AS instruction, output FROM ({SFT_PAIRS}) sp")


# ---------------------------------------------------------------------------
# Answer functions in DuckDB SQL
# ---------------------------------------------------------------------------

def lit(s: str) -> str:
    """DuckDB literal; control characters go through chr() to stay visible."""
    parts, buf = [], ""
    for ch in s:
        if ord(ch) < 32 or ord(ch) in (0x85, 0x2028, 0x2029) or ch.isspace() and ch != " ":
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


WS = lit(PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def brace_len(t: str) -> str:
    pieces = f"list_concat([regexp_extract({t}, '^[^{{}}]*')], regexp_extract_all({t}, '[{{}}][^{{}}]*'))"
    return (f"list_reduce({pieces}, lambda acc, p: CASE WHEN acc.d = 0 THEN acc "
            "WHEN left(p, 1) = '}' THEN {'d': acc.d - 1, 'n': acc.n + CASE WHEN acc.d = 1 THEN 0 ELSE length(p) END} "
            "WHEN left(p, 1) = '{' THEN {'d': acc.d + 1, 'n': acc.n + length(p)} "
            "ELSE {'d': acc.d, 'n': acc.n + length(p)} END, {'d': 1, 'n': 0}).n")


def extract_box(x: str) -> str:
    t = f"string_split({x}, 'boxed')[-1]"
    return (f"(CASE WHEN {t} = '' THEN '' WHEN left({t}, 1) = '{{' "
            f"THEN substr({t}, 2, {brace_len(f'substr({t}, 2)')}) "
            f"ELSE {strip(f'split_part({t}, {chr(39)}${chr(39)}, 1)')} END)")


PHRASES = ["The answer is:", "The answer is ", "the answer is "]


def extract_answer(x: str) -> str:
    arms = [f"WHEN contains({x}, 'boxed') THEN {extract_box(x)}"]
    for p in PHRASES:
        arms.append(f"WHEN contains({x}, '{p}') THEN {strip(f'string_split({x}, {lit(p)})[-1]')}")
    arms.append(f"ELSE coalesce(regexp_extract_all({x}, '-?\\d*\\.?\\d+')[-1], '')")
    raw = "(CASE " + " ".join(arms) + " END)"
    s = f"regexp_replace({raw}, '\\.$', '')"
    s = f"regexp_replace({s}, '/$', '')"
    s = f"regexp_replace({s}, '^:', '')"
    return strip(s)


def extraction_method(x: str) -> str:
    return (f"(CASE WHEN contains({x}, 'boxed') THEN 'boxed' "
            f"WHEN contains({x}, 'The answer is:') THEN 'answer_is_colon' "
            f"WHEN contains({x}, 'The answer is ') THEN 'answer_is' "
            f"WHEN contains({x}, 'the answer is ') THEN 'answer_is_lower' "
            f"WHEN regexp_matches({x}, '-?\\d*\\.?\\d+') THEN 'last_number' ELSE 'none' END)")


def _g(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


MIXED = r"(\d+)\\frac\{(\d+)\}\{(\d+)\}"


def normalize(x: str) -> str:
    p0 = f"string_split({x}, '=')[1]"
    s = (f"(CASE WHEN (contains({p0}, 'y')::INT + contains({p0}, 'x')::INT + contains({p0}, 'z')::INT) >= 2 "
         f"THEN {x} ELSE string_split({x}, '=')[-1] END)")
    s = _g(s, r"([\\\p{L}\p{N}_]*)/([\\\p{L}\p{N}_]*)", r"\\frac{\1}{\2}")
    for e in REMOVED_EXPRESSIONS:
        s = f"replace({s}, {lit(e)}, '')"
    for a, b in SUBSTITUTIONS:
        s = f"replace({s}, {lit(a)}, {lit(b)})"
    s = f"regexp_replace({s}, {lit(r'^(\.\d)')}, {lit(r'0\1')})"
    s = f"regexp_replace({s}, {lit(r'(^|[^.])\.(' + chr(10) + r'?)$')}, {lit(r'\1\2')})"
    s = _g(s, r"(\\text\{\()(.*?)(\)\})", r"\2")
    s = _g(s, r"(\\text\{)(.*?)(\})", r"\2")
    s = _g(s, r"(\\textbf\{)(.*?)(\})", r"\2")
    s = _g(s, r"(\\overline\{)(.*?)(\})", r"\2")
    s = _g(s, r"(\\boxed\{)(.*)(\})", r"\2")
    s = _g(s, r"(frac)([^{])(\d)", r"frac{\2}{\3}")
    s = _g(s, r"(sqrt)([^{])", r"sqrt{\2}")
    s = _g(s, r"frac\{(\d+)\}(\d+)", r"frac{\1}{\2}")
    s = _g(s, r"frac(\d+)\{(\d+)\}", r"frac{\1}{\2}")
    return f"replace({mixed(s)}, '$', '')"


def mixed(y: str) -> str:
    p = lit(MIXED)
    frac = (f"'\\frac{{' || (TRY_CAST(regexp_extract(m, {p}, 1) AS HUGEINT) * TRY_CAST(regexp_extract(m, {p}, 3) AS HUGEINT)"
            f" + TRY_CAST(regexp_extract(m, {p}, 2) AS HUGEINT))::VARCHAR || '}}{{' || "
            f"TRY_CAST(regexp_extract(m, {p}, 3) AS HUGEINT)::VARCHAR || '}}'")
    fracs = f"list_transform(regexp_extract_all({y}, {p}), lambda m: coalesce({frac}, m))"
    return (f"(CASE WHEN regexp_matches({y}, {p}) THEN array_to_string(list_transform("
            f"string_split_regex({y}, {p}), lambda u, i: u || coalesce(({fracs})[i], '')), '') ELSE {y} END)")


def answer_set(x: str) -> str:
    return f"list_sort(list_distinct(string_split({x}, ',')))"


def rational(x: str, allow_frac: bool = True) -> str:
    arms = [
        f"WHEN regexp_full_match({x}, '-?[0-9]+') THEN {{'n': TRY_CAST({x} AS HUGEINT), 'd': 1::HUGEINT}}",
        f"WHEN regexp_full_match({x}, '-?[0-9]*\\.[0-9]+') THEN {{'n': TRY_CAST(replace({x}, '.', '') AS HUGEINT), "
        f"'d': TRY_CAST('1' || repeat('0', length(split_part({x}, '.', 2))) AS HUGEINT)}}",
    ]
    if allow_frac:
        num = f"TRY_CAST(regexp_extract({x}, 'frac\\{{(-?[0-9]+)\\}}', 1) AS HUGEINT)"
        den = f"TRY_CAST(regexp_extract({x}, '\\}}\\{{(-?[0-9]+)\\}}$', 1) AS HUGEINT)"
        arms.append(f"WHEN regexp_full_match({x}, '-?\\\\frac\\{{-?[0-9]+\\}}\\{{-?[0-9]+\\}}') THEN "
                    f"{{'n': CASE WHEN left({x}, 1) = '-' THEN -{num} ELSE {num} END, 'd': {den}}}")
    return "(CASE " + " ".join(arms) + " END)"


def rat_eq(ra: str, rb: str) -> str:
    return f"(CASE WHEN ({ra}).d <> 0 AND ({rb}).d <> 0 THEN TRY(({ra}).n * ({rb}).d) = TRY(({rb}).n * ({ra}).d) END)"


def _parts(x: str) -> str:
    return (f"string_split(CASE WHEN {x} LIKE '(%)' OR {x} LIKE '[%]' THEN substr({x}, 2, length({x}) - 2) "
            f"ELSE {x} END, ',')")


def _kind(x: str) -> str:
    return f"(CASE WHEN {x} LIKE '[%]' THEN 'list' ELSE 'tuple' END)"


def verdict(g: str, m: str) -> str:
    """Correct? ``g``, ``m`` are normalized gold and model answers."""
    v = f"({_parts(g)})[i]"
    elem = rat_eq(rational("u", False), rational(v, False))
    tuple_eq = (f"(CASE WHEN {_kind(m)} = {_kind(g)} AND len({_parts(m)}) = len({_parts(g)}) THEN "
                f"list_bool_and(list_transform({_parts(m)}, lambda u, i: coalesce({elem}, false))) END)")
    second = (f"(CASE WHEN contains({g}, '=') AND contains({m}, '=') THEN NULL "
              f"WHEN NOT contains({m}, ',') AND NOT contains({g}, ',') THEN {rat_eq(rational(m), rational(g))} "
              f"ELSE {tuple_eq} END)")
    return f"(({answer_set(m)} = {answer_set(g)}) OR coalesce({second}, false))"


# ---------------------------------------------------------------------------
# JSON text as Python's json.dumps writes it, and JSON validity checks
# ---------------------------------------------------------------------------

def _esc_printable(t: str) -> str:
    return f"replace(replace({t}, '\\', '\\\\'), '\"', '\\\"')"


def json_string(x: str) -> str:
    short = " ".join(f"WHEN t = chr({ord(k)}) THEN '{v}'" for k, v in
                     [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")])
    other = (f"CASE {short} WHEN unicode(t) < 65536 THEN printf('\\u%04x', unicode(t)) "
             "ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(t) - 65536) >> 10), "
             "56320 + ((unicode(t) - 65536) & 1023)) END")
    slow = (f"array_to_string(list_transform(regexp_extract_all({x}, '[ -~]+|(?s:.)'), lambda t: "
            f"CASE WHEN regexp_matches(t, '^[ -~]') THEN {_esc_printable('t')} ELSE {other} END), '')")
    return (f"coalesce('\"' || CASE WHEN regexp_full_match({x}, '[ -~]*') THEN {_esc_printable(x)} ELSE {slow} END "
            f"|| '\"', 'null')")


def json_object(fields: list[tuple[str, str]]) -> str:
    parts = []
    for i, (k, e) in enumerate(fields):
        parts.append(lit(("" if i == 0 else ", ") + f'"{k}": '))
        parts.append(json_string(e))
    return "('{' || " + " || ".join(parts) + " || '}')"


def json_reason(d: str, add_sol: bool, add_ans: bool) -> str:
    w = f"('[' || {d} || ']')"
    arms = [f"WHEN NOT coalesce(json_valid({w}) AND json_valid({d}), false) OR json_array_length({w}) <> 1 THEN 'not_json'",
            f"WHEN json_type({d}) <> 'OBJECT' THEN 'not_object'",
            f"WHEN coalesce(json_type({d}, '$.problem'), '') <> 'VARCHAR' THEN 'problem_not_string'"]
    if add_sol:
        arms.append(f"WHEN coalesce(json_type({d}, '$.solution'), '') <> 'VARCHAR' THEN 'solution_not_string'")
    if add_ans:
        arms.append(f"WHEN coalesce(json_type({d}, '$.answer'), '') <> 'VARCHAR' THEN 'answer_not_string'")
    return "(CASE " + " ".join(arms) + " END)"


# ---------------------------------------------------------------------------
# Scoring chain over any problem table (problem_id, problem, answer)
# ---------------------------------------------------------------------------

def attempts_over(problems_sql: str) -> str:
    return (ATTEMPTS.replace(f"WITH s AS ({SEEDS})", f"WITH s AS ({problems_sql})", 1)
            .replace("CAST(s.answer AS BIGINT)", "TRY_CAST(s.answer AS BIGINT)"))


def scored_ctes(prefix: str, problems_sql: str) -> dict[str, str]:
    a, e, n = f"{prefix}_att", f"{prefix}_ext", f"{prefix}_norm"
    return {
        a: attempts_over(problems_sql),
        e: f"SELECT problem_id, attempt, problem, answer, response, {extract_answer('response')} AS model_answer FROM {a}",
        n: f"SELECT *, {normalize('answer')} AS gold_norm, {normalize('model_answer')} AS model_norm FROM {e}",
        f"{prefix}_scored": f"SELECT *, {verdict('gold_norm', 'model_norm')} AS correct FROM {n}",
    }


def kept_sql(prefix: str, subset: str, model: str, num_sample: int = 3) -> str:
    return (f"SELECT '{subset}' AS subset, problem_id, problem, response AS solution, answer, '{model}' AS source "
            f"FROM {prefix}_scored WHERE attempt < {num_sample} AND correct")
