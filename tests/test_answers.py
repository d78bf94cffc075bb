"""Golden answers for extraction, normalization and comparison (hand-traced)."""
import random
import re

import pytest
from pyspark.sql import functions as F

from boxwise.functions import answers as A
from boxwise.functions.registry import register_sql_functions
from boxwise.operators import verify

EXTRACT = [
    ("$\\boxed{\\frac{1}{2}}$.", "\\frac{1}{2}"),
    ("\\boxed{1} \\boxed{2}", "2"),
    ("\\boxed{a{b", "a{b"),
    ("\\boxed 5$ z", "5"),
    ("boxed", ""),
    ("\\boxed{5.}", "5"),
    ("The answer is: 42.", "42"),
    ("The answer is: 1 The answer is: 2", "2"),
    ("The answer is 3/", "3"),
    ("the answer is : 5", "5"),
    ("we get 12 then -3.5", "-3.5"),
    ("x-3", "-3"),
    ("version 1.2.3", ".3"),
    ("none", ""),
    ("\\boxed{a{b}c}d}", "a{b}c"),
    ("", ""),
]

NORMALIZE = [
    ("1/2", "\\frac{1}{2}"), ("x=5", "5"), ("x+y=5", "x+y=5"), ("x=y=3", "3"),
    (".5", "0.5"), ("5.", "5"), ("10\\%", "10"), ("\\$1,250", "1,250"),
    ("12 cm", "12"), ("minutes 7", "7"), ("1\\frac{1}{2}", "\\frac{3}{2}"),
    ("01\\frac{02}{3}", "\\frac{5}{3}"), ("\\dfrac12", "\\frac{1}{2}"),
    ("\\tfrac12", "\\tfrac{1}{2}"), ("\\frac{3}4", "\\frac{3}{4}"),
    ("a/b/c", "\\frac{a}{b}\\frac{}{c}"), ("\\sqrt2", "\\sqrt{2}"),
    ("\\sqrt[3]{8}", "\\sqrt{[}3]{8}"), ("\\text{(A)}", "A"), ("\\text{5 m}", "5m"),
    ("6\\text{ m}", "6"), ("\\mbox{cm}", ""), ("$5.$", "5"), ("90^\\circ", "90"),
    ("1{,}000", "1000"), ("3,\\text{and}4", "3,4"), ("\\text{}^3", "^3"),
    ("\\rightarrow", "arrow"), ("\\left(1,2\\right)", "(1,2)"), ("", ""),
]

COMPARE = [
    ("1/2", "\\frac{1}{2}", True), ("1,2", "2,1", True), ("1,1,2", "1,2", True),
    ("", "", True), ("5", "x=5", True), ("10\\%", "10", True), ("(1,2)", "(2,1)", False),
    ("\\frac{2}{4}", "1/2", True), ("3", "4", False), ("0.5", "\\frac{1}{2}", True),
    ("(1,2)", "(1,2.0)", True), ("abc", "", False),
]


def _one(spark, values, expr_fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", F.expr(expr_fn("s")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_extract_answer(spark):
    got = _one(spark, [i for i, _ in EXTRACT], A.extract_answer)
    assert got == [o for _, o in EXTRACT]


def test_normalize(spark):
    got = _one(spark, [i for i, _ in NORMALIZE], A.normalize_answer)
    assert got == [o for _, o in NORMALIZE]


def test_compare(spark):
    df = spark.createDataFrame([(i, g, m) for i, (g, m, _) in enumerate(COMPARE)], "i int, g string, m string")
    df = df.select("i", F.expr(A.normalize_answer("g")).alias("ng"), F.expr(A.normalize_answer("m")).alias("nm"))
    got = [r.v for r in df.select("i", F.expr(A.verdict("ng", "nm")).alias("v")).orderBy("i").collect()]
    assert got == [v for _, _, v in COMPARE]


def test_locate_box(spark):
    df = spark.createDataFrame([("ab \\boxed{xy} c",), ("no box",)], "s string")
    got = [r.r for r in df.select(F.expr(A.locate_box("s")).alias("r")).collect()]
    assert got[0].pos == 11 and got[0].len == 2 and got[1] is None


def test_staged_dataframe_path_matches_golden(spark):
    """The staged DataFrame path (guards, Generate-bound folds) gives the
    same answers as the nested templates."""
    from boxwise.operators import verify
    rows = [(i, v) for i, (v, _) in enumerate(EXTRACT)] + [(100, "\\boxed{a{b{c{d{e}}}}}f}")]
    df = spark.createDataFrame(rows, "i int, s string")
    got = {r.i: r.model_answer for r in verify.extract_answers(df, "s").collect()}
    for i, (_, o) in enumerate(EXTRACT):
        assert got[i] == o
    assert got[100] == "a{b{c{d{e}}}}"
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(NORMALIZE)] + [(99, "sqrtfrac1{2}")],
                               "i int, s string")
    got = {r.i: r.n for r in verify.normalize(df, "s", "n").collect()}
    for i, (_, o) in enumerate(NORMALIZE):
        assert got[i] == o
    assert got[99] == "sqrt{f}rac1{2}"


def test_verdict_plans_agree(spark):
    from boxwise.operators import verify
    df = spark.createDataFrame([(i, g, m) for i, (g, m, _) in enumerate(COMPARE)], "i int, answer string, model_answer string")
    for plan in ("narrow", "distinct"):
        got = {r.i: r.correct for r in verify.verify_answers(df, plan=plan).collect()}
        assert [got[i] for i in range(len(COMPARE))] == [v for _, _, v in COMPARE]


def test_sql_functions(spark):
    from boxwise.functions.registry import register_sql_functions
    names = register_sql_functions(spark)
    assert "bw_extract_answer" in names
    spark.createDataFrame([(i, v) for i, (v, _) in enumerate(EXTRACT)], "i int, s string") \
        .createOrReplaceTempView("bw_ex")
    got = {r.i: r.a for r in spark.sql("SELECT i, bw_extract_answer(s) AS a FROM bw_ex").collect()}
    assert [got[i] for i in range(len(EXTRACT))] == [o for _, o in EXTRACT]
    r = spark.sql("SELECT bw_answers_match('1/2', '\\\\frac{2}{4}') AS m, bw_normalize_answer('10\\\\%') AS n, "
                  "bw_json_string('a\"b') AS j").collect()[0]
    assert r.m is True and r.n == "10" and r.j == '"a\\"b"'


def test_locate_box_reference_position(spark):
    """The reference counts from the first box but measures the last one."""
    s = "a \\boxed{1} b \\boxed{22}"
    df = spark.createDataFrame([(s,)], "s string")
    ours = df.select(F.expr(A.locate_box("s")).alias("r")).collect()[0].r
    ref = df.select(F.expr(A.locate_box("s", reference_position=True)).alias("r")).collect()[0].r
    assert s[ours.pos - 1:ours.pos - 1 + ours.len] == "22"
    # 0-based: find('\\boxed') + len('\\boxed') + after_box.find(a), with after_box = '{22}'
    assert ref.pos - 1 == s.find("\\boxed") + len("\\boxed") + "{22}".find("22") and ref.len == 2


def test_normalize_once_equals_the_nested_chain(spark):
    """The staged forms give what the nested templates give, on answers put
    together at random from all that the chain removes, replaces or rewrites."""
    r = random.Random(3)
    bits = A.REMOVED_EXPRESSIONS + [b for b, _ in A.SUBSTITUTIONS] + list("0123456789") * 3 + [
        "=", "x", "y", "/", ".", ",", "$", "\\frac{1}{2}", "1\\frac{1}{2}", "frac12", "sqrt2", "\\text{a}", "\\text{(B)}",
        "\\textbf{c}", "\\overline{x}", "\\boxed{3}", "(", ")", "[", "]", "-", "{", "}", "\\", "\n", "\u00b2", "lef", "t"]
    values = [None, "", "-5", "1,2", "2,1", "1,1"] + ["".join(r.choices(bits, k=r.randint(1, 6))) for _ in range(600)]
    df = spark.createDataFrame([(v, r.choice([v, r.choice(values)])) for v in values], "s string, t string")
    df = df.select("s", F.expr(A.normalize_answer("s")).alias("a"), F.expr(A.normalize_answer("t")).alias("b"),
                   F.expr(A.normalize_once("s")).alias("once")).select(
        "*", F.expr(A.verdict("a", "b")).alias("v"), F.expr(A.verdict_once("a", "b")).alias("v_once"))
    rows = df.collect()
    assert {x.v for x in rows} == {True, False}
    assert [(x.a, x.v) for x in rows] == [(x.once, x.v_once) for x in rows]


def test_answer_check_is_compiled(spark, capsys):
    """No method that Spark generates for the answer check passes the 8,000 bytes
    up to which the JVM compiles a method: above, every row is interpreted."""
    df = spark.createDataFrame([("a \\boxed{5}", "5")], "response string, answer string")
    df = verify.verify_answers(verify.extract_answers(df), "answer", "model_answer")
    df.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_sql_functions_compute_each_step_once(spark):
    register_sql_functions(spark)
    df = spark.sql("SELECT bw_answers_match(a, b) AS m FROM VALUES ('1\\\\frac{1}{2}', '3/2'), ('7', '8') AS t(a, b)")
    assert [r.m for r in df.collect()] == [True, False]
    # the step that ends in this replacement: once for each of the two answers
    df = spark.range(2).selectExpr("CAST(id AS STRING) AS a", "CAST(id + 1 AS STRING) AS b")
    df.createOrReplaceTempView("bw_test_pairs")
    plan = spark.sql("SELECT bw_answers_match(a, b) AS m FROM bw_test_pairs")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sqrt{$2}") == 2
