"""Random answers through the Spark jobs and the separately written DuckDB
SQL; plus the properties SURVEY §5 asks for (reflexive, symmetric)."""
import random

import duckdb
import pytest

from boxwise.operators import verify
from boxwise.plans import oracle as O

PIECES = ["1", "2", "12", "0", "-", ".", ".5", "/", "\\frac", "\\dfrac", "{", "}", "\\boxed", "boxed", "$",
          ",", "=", "x", "y", "z", " ", "\\text", "\\textbf", "(", ")", "\\sqrt", "^\\circ", "\\%", "cm",
          "The answer is: ", "the answer is ", "\\left", "\\right", "\\!", "{,}", "3", "7", "\\mbox", "and",
          "\\overline", "a", "b", "\n", "\\$", "sqrt", "frac", "dollars", "\\text{ }"]


def random_strings(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


def duck_eval(expr, values):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    return dict(con.execute(f"SELECT i, {expr} FROM t").fetchall())


@pytest.mark.parametrize("seed", [1, 2])
def test_extract_and_normalize_agree_with_oracle(spark, seed):
    vals = random_strings(400, seed)
    df = spark.createDataFrame(list(enumerate(vals)), "i int, s string")
    ex = {r.i: r.m for r in verify.extract_answers(df, "s", "m").collect()}
    assert ex == duck_eval(O.extract_answer("s"), vals)
    nm = {r.i: r.n for r in verify.normalize(df, "s", "n").collect()}
    want = duck_eval(O.normalize("s"), vals)
    bad = {i: (vals[i], nm[i], want[i]) for i in nm if nm[i] != want[i]}
    assert not bad


def test_verdict_properties(spark):
    vals = random_strings(300, 3)
    rnd = random.Random(4)
    pairs = [(a, rnd.choice(vals)) for a in vals]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, answer string, model_answer string")
    fwd = {r.i: r.correct for r in verify.verify_answers(df, plan="narrow").collect()}
    rev_df = spark.createDataFrame([(i, b, a) for i, a, b in rows], "i int, answer string, model_answer string")
    rev = {r.i: r.correct for r in verify.verify_answers(rev_df, plan="distinct").collect()}
    same = spark.createDataFrame([(i, a, a) for i, a, _ in rows], "i int, answer string, model_answer string")
    refl = {r.i: r.correct for r in verify.verify_answers(same).collect()}
    assert all(refl.values())                       # reflexive
    assert fwd == rev                               # symmetric (and both plans agree)
    con = duckdb.connect()
    con.execute("CREATE TABLE p(i INTEGER, g VARCHAR, m VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    want = dict(con.execute(f"SELECT i, {O.verdict('ng', 'nm')} FROM (SELECT i, {O.normalize('g')} AS ng, "
                            f"{O.normalize('m')} AS nm FROM p)").fetchall())
    assert fwd == want
