"""Final-answer extraction, normalization and comparison as native Spark SQL.

Every function here takes the SQL text of its input(s) and returns the SQL
text of an expression, so one definition serves three uses: ``F.expr`` columns
in DataFrame jobs (see ``col_*`` helpers), ``CREATE TEMPORARY FUNCTION``
bodies (``boxwise.functions.registry``) and plain ``spark.sql``. No Python UDF
is involved: every step is a built-in string, regex, array or decimal
expression, so it runs inside whole-stage codegen where Spark allows it.

Regexes follow Python's ``re`` defaults: ``(?U)`` gives Unicode ``\\d``, word
characters are spelled out (Java's ``\\w`` lacks superscripts and fractions and
has combining marks), and ``(?d)`` makes ``\\n`` the only line end for ``.`` and ``$``.

Callers should pass column names (or cheap expressions): several templates
use their input more than once, and the DataFrame helpers stage deep
expressions into their own projections so Catalyst does not inline them twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes (derived from str.isspace).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

# ---------------------------------------------------------------------------
# They must equal the reference's lists for equal results.
# The reference's list has no comma after '\\text{ }^2', so Python fuses it
# with the next entry into one string; that fused entry is kept as is.
# ---------------------------------------------------------------------------
SUBSTITUTIONS = [
    ('.$', '$'), ('\\$', ''), ('\\%', ''),
    ('mbox', 'text'), (',\\text{and}', ','), ('\\text{and}', ','),
    ('\\text{m}', '\\text{}'), ('dfrac', 'frac'),
]
REMOVED_EXPRESSIONS = [
    '\\left', '\\right', '\\quad', 'calories', 'calory', 'values', 'value',
    'square', 'ways', 'integers', 'dollars', 'mph', 'inches', 'miles', 'euros', 'euro',
    'hours', 'km', 'units', '\\ldots', 'sue', 'points', 'feet', 'centi', 'days',
    'minutes', 'digits', 'cents', 'degrees', 'cm', 'gm', 'pounds', 'dogs', 'boxes',
    'gallons', 'gallon', 'cubic', 'min', 'distinct', 'pieces', 'piece', 'USD', 'daps',
    'dap', 'meters', 'meals', 'edges', 'students', 'childrentickets', 'multiples',
    '\\text{ s}', '\\text{ }', '\\text{s}', '\\text{.}', '\\text{\ns}', '\\text{}^2',
    '\\text{ }^2\\text{}^3',
    '\\text{ }^3', '\\text{\n}', '\\text{}', r'\mathrm{th}',
    r'^\circ', r'^{\circ}', r'\,', r'\;', r',\!', '{,}', '"', '\\dots',
    r'\ ', ' ',
]
# Phrases of the extraction cascade, in order of precedence.
ANSWER_PHRASES = ['The answer is:', 'The answer is ', 'the answer is ']
LAST_NUMBER = r'(?U)-?\d*\.?\d+'
# Python's \\w: letters, all kinds of numbers, underscore.
SLASH = r'([\\\p{L}\p{N}_]*)/([\\\p{L}\p{N}_]*)'
MIXED_NUMBER = r'(?U)(\d+)\\frac\{(\d+)\}\{(\d+)\}'

# Names of the extraction rules (A4 reports these).
METHODS = ['boxed', 'answer_is_colon', 'answer_is', 'answer_is_lower', 'last_number', 'none']


def sql_str(s: str) -> str:
    """A Spark SQL string literal holding exactly ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def py_strip(x: str) -> str:
    """Python ``str.strip()``: remove Unicode white space at both ends."""
    return f"btrim({x}, {sql_str(PY_WHITESPACE)})"


def _rx(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {sql_str(pattern)}, {sql_str(repl)})"


# ---------------------------------------------------------------------------
# A1 / A2: boxed answers
# ---------------------------------------------------------------------------

def brace_content_length(t: str) -> str:
    """Characters of ``t`` before the brace that closes an already open one.

    ``t`` is cut before each brace; a fold over the pieces tracks the depth,
    so the work is per brace, not per character. Unbalanced: all of ``t``.
    """
    return (
        f"aggregate(split({t}, {sql_str('(?=[{}])')}), named_struct('d', 1, 'n', 0), "
        "(acc, p) -> CASE WHEN acc.d = 0 THEN acc "
        "WHEN left(p, 1) = '}' THEN named_struct('d', acc.d - 1, "
        "'n', acc.n + IF(acc.d = 1, 0, char_length(p))) "
        "WHEN left(p, 1) = '{' THEN named_struct('d', acc.d + 1, 'n', acc.n + char_length(p)) "
        "ELSE named_struct('d', acc.d, 'n', acc.n + char_length(p)) END, "
        "acc -> acc.n)"
    )


def extract_box(x: str) -> str:
    """Text after the last ``boxed``: brace-matched when it opens with ``{``,
    else up to the first ``$`` and stripped; ``''`` when nothing follows."""
    t = f"substring_index({x}, 'boxed', -1)"
    return (
        f"(CASE WHEN {t} = '' THEN '' "
        f"WHEN left({t}, 1) = '{{' THEN substr({t}, 2, {brace_content_length(f'substr({t}, 2)')}) "
        f"ELSE {py_strip(f'substring_index({t}, {sql_str(chr(36))}, 1)')} END)"
    )


def locate_box(x: str, reference_position: bool = False) -> str:
    """A2: struct(pos, len) of the last box's content (1-based position).

    Null when the last ``\\boxed`` is not followed by ``{`` (the reference
    raises there). ``reference_position=True`` reproduces the reference's
    position, which counts from the *first* ``\\boxed`` and searches the last
    box's text from there (wrong when there are several boxes).
    """
    t = f"substring_index({x}, '\\\\boxed', -1)"
    n = brace_content_length(f"substr({t}, 2)")
    if reference_position:
        # 0-based: find('\\boxed') + 6 + after_box.find(a); returned 1-based here.
        pos = (f"(locate('\\\\boxed', {x}) - 1 + 6 + "
               f"locate(substr({t}, 2, {n}), {t}) - 1 + 1)")
    else:
        pos = f"(char_length({x}) - char_length({t}) + 2)"
    return (f"(CASE WHEN contains({x}, '\\\\boxed') AND left({t}, 1) = '{{' "
            f"THEN named_struct('pos', {pos}, 'len', {n}) END)")


# ---------------------------------------------------------------------------
# A3 / A4: the extraction cascade
# ---------------------------------------------------------------------------

def extraction_method(x: str) -> str:
    arms = [f"WHEN contains({x}, 'boxed') THEN 'boxed'"]
    for phrase, name in zip(ANSWER_PHRASES, METHODS[1:4]):
        arms.append(f"WHEN contains({x}, {sql_str(phrase)}) THEN '{name}'")
    arms.append(f"WHEN {x} RLIKE {sql_str(LAST_NUMBER)} THEN 'last_number'")
    return "(CASE " + " ".join(arms) + " ELSE 'none' END)"


def raw_answer(x: str) -> str:
    """The cascade before the final clean-up."""
    arms = [f"WHEN contains({x}, 'boxed') THEN {extract_box(x)}"]
    for phrase in ANSWER_PHRASES:
        arms.append(f"WHEN contains({x}, {sql_str(phrase)}) THEN "
                    f"{py_strip(f'substring_index({x}, {sql_str(phrase)}, -1)')}")
    arms.append(f"ELSE coalesce(try_element_at(regexp_extract_all({x}, {sql_str(LAST_NUMBER)}, 0), -1), '')")
    return "(CASE " + " ".join(arms) + " END)"


def clean_answer(p: str) -> str:
    """Drop one trailing '.', then one trailing '/', then one leading ':'; strip."""
    s = _rx(p, r'\.\z', '')
    s = _rx(s, r'/\z', '')
    s = _rx(s, r'\A:', '')
    return py_strip(s)


def extract_answer(x: str) -> str:
    """A3: final answer of a model output."""
    return clean_answer(raw_answer(x))


# ---------------------------------------------------------------------------
# Normalization chain
# ---------------------------------------------------------------------------

def normalize_head(x: str) -> str:
    """Steps 1-8 of the chain (everything before mixed numbers)."""
    p0 = f"substring_index({x}, '=', 1)"
    xyz = " + ".join(f"CAST(contains({p0}, '{v}') AS INT)" for v in ("y", "x", "z"))
    s = f"(CASE WHEN ({xyz}) >= 2 THEN {x} ELSE substring_index({x}, '=', -1) END)"
    s = _rx(s, SLASH, r'\\frac{$1}{$2}')
    for expr in REMOVED_EXPRESSIONS:
        s = f"replace({s}, {sql_str(expr)}, '')"
    for before, after in SUBSTITUTIONS:
        s = f"replace({s}, {sql_str(before)}, {sql_str(after)})"
    s = _rx(s, r'(?U)^(\.\d)', '0$1')
    s = _rx(s, r'(?d)(?<!\.)\.$', '')
    s = _rx(s, r'(?d)(\\text\{\()(.*?)(\)\})', '$2')
    s = _rx(s, r'(?d)(\\text\{)(.*?)(\})', '$2')
    s = _rx(s, r'(?d)(\\textbf\{)(.*?)(\})', '$2')
    s = _rx(s, r'(?d)(\\overline\{)(.*?)(\})', '$2')
    s = _rx(s, r'(?d)(\\boxed\{)(.*)(\})', '$2')
    s = _rx(s, r'(?U)(frac)([^{])(\d)', 'frac{$2}{$3}')
    s = _rx(s, r'(sqrt)([^{])', 'sqrt{$2}')
    s = _rx(s, r'(?U)frac\{(\d+)\}(\d+)', 'frac{$1}{$2}')
    s = _rx(s, r'(?U)frac(\d+)\{(\d+)\}', 'frac{$1}{$2}')
    return s


def mixed_numbers(y: str) -> str:
    """``a\\frac{b}{c}`` -> ``\\frac{a*c+b}{c}`` at each match, exact in
    decimal(38,0); a match whose numbers overflow is left as it is."""
    p = sql_str(MIXED_NUMBER)
    dec = "DECIMAL(38,0)"
    a = f"try_cast(regexp_extract(m, {p}, 1) AS {dec})"
    b = f"try_cast(regexp_extract(m, {p}, 2) AS {dec})"
    c = f"try_cast(regexp_extract(m, {p}, 3) AS {dec})"
    frac = (f"coalesce(concat('\\\\frac{{', CAST(try_add(try_multiply({a}, {c}), {b}) AS STRING), "
            f"'}}{{', CAST({c} AS STRING), '}}'), m)")
    fracs = f"transform(regexp_extract_all({y}, {p}, 0), m -> {frac})"
    return (f"(CASE WHEN {y} RLIKE {p} THEN array_join(zip_with(split({y}, {p}), "
            f"concat({fracs}, array('')), (u, v) -> concat(u, v)), '') ELSE {y} END)")


def normalize_tail(y: str) -> str:
    """Steps 9-10: mixed numbers, then delete every ``$``."""
    return f"replace({mixed_numbers(y)}, '$', '')"


def normalize_answer(x: str) -> str:
    """A5: the whole chain (inlines its input several times; stage it)."""
    return normalize_tail(normalize_head(x))


# ---------------------------------------------------------------------------
# comparison
# ---------------------------------------------------------------------------

def answer_set(x: str) -> str:
    return f"sort_array(array_distinct(split({x}, ',', -1)))"


def set_equal(a: str, b: str) -> str:
    """Equal as sets of comma-separated parts."""
    return f"({answer_set(a)} = {answer_set(b)})"


_DEC = "DECIMAL(38,0)"
_INT_RX = r'^-?[0-9]+\z'
_DECIMAL_RX = r'^-?[0-9]*\.[0-9]+\z'
_FRAC_RX = r'^-?\\frac\{-?[0-9]+\}\{-?[0-9]+\}\z'


def rational_value(x: str, allow_frac: bool = True) -> str:
    """struct(n, d) of an integer, decimal or ``\\frac{a}{b}`` (null otherwise)."""
    one = f"CAST(1 AS {_DEC})"
    arms = [
        f"WHEN {x} RLIKE {sql_str(_INT_RX)} THEN named_struct('n', try_cast({x} AS {_DEC}), 'd', {one})",
        f"WHEN {x} RLIKE {sql_str(_DECIMAL_RX)} THEN named_struct("
        f"'n', try_cast(replace({x}, '.', '') AS {_DEC}), "
        f"'d', try_cast(concat('1', repeat('0', char_length(substring_index({x}, '.', -1)))) AS {_DEC}))",
    ]
    if allow_frac:
        num = f"try_cast(regexp_extract({x}, {sql_str(r'frac\{(-?[0-9]+)\}')}, 1) AS {_DEC})"
        den = f"try_cast(regexp_extract({x}, {sql_str(r'\}\{(-?[0-9]+)\}\z')}, 1) AS {_DEC})"
        arms.append(
            f"WHEN {x} RLIKE {sql_str(_FRAC_RX)} THEN named_struct("
            f"'n', IF(left({x}, 1) = '-', -{num}, {num}), 'd', {den})")
    return "(CASE " + " ".join(arms) + " END)"


def rational_equal(ra: str, rb: str) -> str:
    """Cross-multiplied equality of two struct(n, d); null when undecided."""
    return (f"(CASE WHEN {ra}.d <> 0 AND {rb}.d <> 0 THEN "
            f"try_multiply({ra}.n, {rb}.d) = try_multiply({rb}.n, {ra}.d) END)")


def value_equal(a: str, b: str) -> str:
    """Same rational value (integer, decimal, fraction, sign)."""
    return rational_equal(rational_value(a), rational_value(b))


def _tuple_parts(x: str) -> str:
    return (f"split(CASE WHEN {x} LIKE '(%)' OR {x} LIKE '[%]' "
            f"THEN substr({x}, 2, char_length({x}) - 2) ELSE {x} END, ',', -1)")


def _tuple_kind(x: str) -> str:
    return f"(CASE WHEN {x} LIKE '[%]' THEN 'list' ELSE 'tuple' END)"


def tuple_equal(a: str, b: str) -> str:
    """Ordered element-wise numeric equality inside the same brackets."""
    elem = rational_equal(rational_value("u", False), rational_value("v", False))
    return (f"(CASE WHEN {_tuple_kind(a)} = {_tuple_kind(b)} "
            f"AND size({_tuple_parts(a)}) = size({_tuple_parts(b)}) THEN "
            f"forall(zip_with({_tuple_parts(a)}, {_tuple_parts(b)}, (u, v) -> {elem}), t -> t) END)")


def second_chance(gold_norm: str, model_norm: str) -> str:
    """The arm used when the set comparison fails (null = undecided)."""
    return (f"(CASE WHEN contains({gold_norm}, '=') AND contains({model_norm}, '=') THEN NULL "
            f"WHEN NOT contains({model_norm}, ',') AND NOT contains({gold_norm}, ',') "
            f"THEN {value_equal(model_norm, gold_norm)} "
            f"ELSE {tuple_equal(model_norm, gold_norm)} END)")


def verdict(gold_norm: str, model_norm: str) -> str:
    """A10 on normalized strings: set arm, else second chance, null -> false."""
    return (f"coalesce({set_equal(model_norm, gold_norm)} OR "
            f"coalesce({second_chance(gold_norm, model_norm)}, false), false)")


# ---------------------------------------------------------------------------
# Column helpers (inputs are column names)
# ---------------------------------------------------------------------------

def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col_extraction_method(name: str) -> Column:
    return F.expr(extraction_method(_q(name)))


def col_extract_box(name: str) -> Column:
    return F.expr(extract_box(_q(name)))


def col_locate_box(name: str, reference_position: bool = False) -> Column:
    return F.expr(locate_box(_q(name), reference_position))


def col_set_equal(a: str, b: str) -> Column:
    return F.expr(set_equal(_q(a), _q(b)))


def col_rational(name: str) -> Column:
    return F.expr(rational_value(_q(name)))


def col_verdict(gold_norm: str, model_norm: str) -> Column:
    return F.expr(verdict_once(_q(gold_norm), _q(model_norm)))


# ---------------------------------------------------------------------------
# Staged forms for DataFrame jobs
#
# Same results as the nested templates above, laid out for the optimizer:
# * each regex step is guarded by a substring test that any match needs, so
#   most answers skip most regexes; a guard reads its input twice, which
#   keeps the step in its own projection (computed once, inside codegen);
# * higher-order functions (the brace fold, the normalization) are not
#   code-generated and would pull a whole projection out of codegen, so they
#   run behind a Generate or in a projection of their own, only for rows that
#   need them. In one generated method the 60 replacements of a chain pass the
#   8,000 bytes up to which the JVM compiles a method, and are interpreted.
# ---------------------------------------------------------------------------

# A box whose braces nest at most 4 deep, matched without a fold.
_BOX_FAST = (r'^(\{(?:[^{}]++|\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\})*+\})')


def _guard(x: str, needle: str, expr: str) -> str:
    return f"(CASE WHEN contains({x}, {sql_str(needle)}) THEN {expr} ELSE {x} END)"


def let(x: str, *steps) -> str:
    """``steps`` applied to ``x`` one after the other, each result computed once."""
    out = f"array({x})"
    for i, step in enumerate(steps):
        out = f"transform({out}, _v{i} -> {step(f'_v{i}')})"
    return f"element_at({out}, 1)"


def _any_of(needles: list[str]) -> str:
    """A regex that finds any of ``needles``."""
    least = sorted({n for n in needles if not any(m != n and m in n for m in needles)})
    first = "".join(sorted({"\\" + n[0] if not n[0].isalnum() else n[0] for n in least}))
    return f"(?=[{first}])(?:" + "|".join(rf"\Q{n}\E" for n in least) + ")"


_REPLACEMENTS = [(e, '') for e in REMOVED_EXPRESSIONS] + SUBSTITUTIONS
_REPLACED = _any_of([e for e, _ in _REPLACEMENTS])
# Every step of the chain needs one of these; the backslash stands for all commands.
_NORMALIZED = _any_of([e for e, _ in _REPLACEMENTS] + ["=", "/", ".", "$", "\\", "frac", "sqrt"])


def normalize_steps() -> list:
    """Steps of ``normalize_answer`` as functions of the previous value."""
    def eq_split(x):
        p0 = f"substring_index({x}, '=', 1)"
        xyz = " + ".join(f"CAST(contains({p0}, '{v}') AS INT)" for v in ("y", "x", "z"))
        return _guard(x, "=", f"(CASE WHEN ({xyz}) >= 2 THEN {x} ELSE substring_index({x}, '=', -1) END)")

    def removals(x):
        s = x
        for before, after in _REPLACEMENTS:
            s = f"replace({s}, {sql_str(before)}, {sql_str(after)})"
        return f"(CASE WHEN {x} RLIKE {sql_str(_REPLACED)} THEN {s} ELSE {x} END)"

    def rx(needle, pattern, repl):
        return lambda x: _guard(x, needle, _rx(x, pattern, repl))

    return [
        eq_split,
        rx("/", SLASH, r'\\frac{$1}{$2}'),
        removals,
        lambda x: f"(CASE WHEN startswith({x}, '.') THEN {_rx(x, r'(?U)^(\.\d)', '0$1')} ELSE {x} END)",
        rx(".", r'(?d)(?<!\.)\.$', ''),
        rx("\\text{(", r'(?d)(\\text\{\()(.*?)(\)\})', '$2'),
        rx("\\text{", r'(?d)(\\text\{)(.*?)(\})', '$2'),
        rx("\\textbf{", r'(?d)(\\textbf\{)(.*?)(\})', '$2'),
        rx("\\overline{", r'(?d)(\\overline\{)(.*?)(\})', '$2'),
        rx("\\boxed{", r'(?d)(\\boxed\{)(.*)(\})', '$2'),
        rx("frac", r'(?U)(frac)([^{])(\d)', 'frac{$2}{$3}'),
        rx("sqrt", r'(sqrt)([^{])', 'sqrt{$2}'),
        lambda x: _guard(x, "frac", _rx(_rx(x, r'(?U)frac\{(\d+)\}(\d+)', 'frac{$1}{$2}'),
                                        r'(?U)frac(\d+)\{(\d+)\}', 'frac{$1}{$2}')),
        lambda x: _guard(x, "\\frac{", mixed_numbers(x)),
        lambda x: f"replace({x}, '$', '')",
    ]


def normalize_once(x: str) -> str:
    """``normalize_answer`` with every step computed once, and only for a value
    that has something to normalize. ``x`` is read three times: a column."""
    return f"(CASE WHEN {x} RLIKE {sql_str(_NORMALIZED)} THEN {let(x, *normalize_steps())} ELSE {x} END)"


def verdict_once(gold_norm: str, model_norm: str) -> str:
    """``verdict`` for columns: equal strings are equal sets, strings without a
    comma are sets of one, and both rational values are computed once."""
    g, m = gold_norm, model_norm
    pair = f"named_struct('m', {rational_value(m)}, 'g', {rational_value(g)})"
    value = let(pair, lambda p: rational_equal(f"{p}.m", f"{p}.g"))
    return (f"(CASE WHEN {g} = {m} THEN true "
            f"WHEN contains({g}, ',') OR contains({m}, ',') THEN {verdict(g, m)} "
            f"WHEN contains({g}, '=') AND contains({m}, '=') THEN false ELSE coalesce({value}, false) END)")


def box_fast(t: str) -> str:
    """Balanced box content for nesting up to 4 deep, else ''."""
    return f"regexp_extract({t}, {sql_str(_BOX_FAST)}, 1)"


def strip_guarded(x: str) -> str:
    """``py_strip`` that only trims when an end character is white space
    (reads ``x`` several times: stage it)."""
    ws = sql_str(PY_WHITESPACE)
    return (f"(CASE WHEN {x} = '' THEN {x} WHEN instr({ws}, left({x}, 1)) > 0 OR instr({ws}, right({x}, 1)) > 0 "
            f"THEN {py_strip(x)} ELSE {x} END)")


def clean_answer_steps() -> list:
    """``clean_answer`` as staged steps without regexes."""
    return [
        lambda p: f"(CASE WHEN endswith({p}, '.') THEN substr({p}, 1, char_length({p}) - 1) ELSE {p} END)",
        lambda p: f"(CASE WHEN endswith({p}, '/') THEN substr({p}, 1, char_length({p}) - 1) ELSE {p} END)",
        lambda p: f"(CASE WHEN startswith({p}, ':') THEN substr({p}, 2) ELSE {p} END)",
        strip_guarded,
    ]


def raw_answer_staged(x: str, t: str, box: str) -> str:
    """Cascade given ``t`` (text after the last 'boxed', null without one)
    and ``box`` (fast box match, null unless ``t`` opens with a brace)."""
    arms = [f"WHEN {t} IS NOT NULL THEN (CASE WHEN {t} = '' THEN '' "
            f"WHEN {box} IS NOT NULL THEN (CASE WHEN {box} <> '' THEN substr({box}, 2, char_length({box}) - 2) END) "
            f"ELSE {py_strip(f'substring_index({t}, {sql_str(chr(36))}, 1)')} END)"]
    for phrase in ANSWER_PHRASES:
        arms.append(f"WHEN contains({x}, {sql_str(phrase)}) THEN "
                    f"{py_strip(f'substring_index({x}, {sql_str(phrase)}, -1)')}")
    arms.append(f"ELSE coalesce(try_element_at(regexp_extract_all({x}, {sql_str(LAST_NUMBER)}, 0), -1), '')")
    return "(CASE " + " ".join(arms) + " END)"
