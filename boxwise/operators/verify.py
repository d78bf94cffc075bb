"""A3, A4, A10: extract final answers and decide whether they are right.

Two plans are offered for the verdict:

* ``narrow`` (default): normalize and compare on every row; no shuffle, and
  the input is evaluated once.
* ``distinct``: every distinct (gold, model) pair once, joined back. The input
  is written first, so that it is evaluated once here too; give it keys and
  answers only, as its rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.functions import answers as A
from boxwise.session import cut_lineage


def extract_answers(df: DataFrame, output_col: str = "response", out: str = "model_answer",
                    method_col: str | None = None) -> DataFrame:
    """A3: add the final answer extracted from ``output_col``.

    Staged: the cascade with a regex for boxes nested up to 4 deep runs in
    codegen; only boxes it cannot match (deeper or unbalanced) take the
    brace fold, in a projection of its own.
    """
    if method_col:
        df = df.withColumn(method_col, A.col_extraction_method(output_col))
    x = f"`{output_col}`"
    df = df.withColumn("_bw_t", F.expr(f"CASE WHEN contains({x}, 'boxed') THEN substring_index({x}, 'boxed', -1) END"))
    df = df.withColumn("_bw_box", F.expr(f"CASE WHEN left(_bw_t, 1) = '{{' THEN {A.box_fast('_bw_t')} END"))
    df = df.withColumn("_bw_raw", F.expr(A.raw_answer_staged(x, "_bw_t", "_bw_box")))
    # The fold reads _bw_t and _bw_raw twice, so this projection is never
    # merged with its neighbours: only it leaves codegen (and its CASE only
    # runs the fold for boxes the regex could not match).
    slow = F.expr(f"CASE WHEN _bw_raw IS NULL AND {x} IS NOT NULL THEN substr(_bw_t, 2, "
                  f"{A.brace_content_length('substr(_bw_t, 2)')}) ELSE _bw_raw END")
    df = df.withColumn("_bw_ans", slow).drop("_bw_t", "_bw_box", "_bw_raw")
    for step in A.clean_answer_steps():
        df = df.withColumn("_bw_ans", F.expr(step("_bw_ans")))
    return df.withColumnRenamed("_bw_ans", out) if out not in df.columns else \
        df.withColumn(out, F.col("_bw_ans")).drop("_bw_ans")


def extraction_method_counts(df: DataFrame, output_col: str = "response") -> DataFrame:
    """A4: how often each rule of the cascade fired."""
    return (df.select(A.col_extraction_method(output_col).alias("method"))
            .groupBy("method").agg(F.count(F.lit(1)).alias("n")))


def bind(df: DataFrame, **exprs) -> DataFrame:
    """Add columns computed once behind a one-row ``inline`` (a Generate).

    Catalyst substitutes projected aliases into filters it pushes down; for
    the ~80-call normalization chain, referenced many times by the verdict,
    that would inline the chain dozens of times into one predicate. A
    Generate is a point filters on its output cannot be pushed past.
    """
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(k) for k, e in exprs.items()]))))


def normalize(df: DataFrame, col: str, out: str) -> DataFrame:
    """A5 bound behind a Generate."""
    return bind(df, **{out: F.expr(A.normalize_once(f"`{col}`"))})


def normalize_pair(df: DataFrame, gold_col: str, model_col: str) -> DataFrame:
    return bind(df, gold_norm=F.expr(A.normalize_once(f"`{gold_col}`")),
                model_norm=F.expr(A.normalize_once(f"`{model_col}`")))


def _verdict_columns(df: DataFrame, gold_col: str, model_col: str, out: str,
                     keep_normalized: bool) -> DataFrame:
    df = normalize_pair(df, gold_col, model_col)
    # on distinct pairs the whole verdict in one projection measured fastest
    df = df.withColumn(out, A.col_verdict("gold_norm", "model_norm"))
    return df if keep_normalized else df.drop("gold_norm", "model_norm")


def verify_answers(df: DataFrame, gold_col: str = "answer", model_col: str = "model_answer",
                   out: str = "correct", plan: str = "narrow",
                   keep_normalized: bool = False) -> DataFrame:
    """A10: boolean verdict comparing gold and model answers.

    ``narrow`` (default): per row; ``distinct``: every distinct pair once,
    joined back. A null answer on either side is not correct.
    """
    if plan == "narrow":
        return _verdict_columns(df, gold_col, model_col, out, keep_normalized)
    if plan != "distinct":
        raise ValueError(f"unknown plan {plan!r}; use 'distinct' or 'narrow'")
    df = cut_lineage(df, "verify")
    pairs = df.select(F.col(gold_col).alias("_g"), F.col(model_col).alias("_m")).distinct()
    verdicts = _verdict_columns(pairs, "_g", "_m", out, keep_normalized)
    cond = (F.col(gold_col).eqNullSafe(F.col("_g"))) & (F.col(model_col).eqNullSafe(F.col("_m")))
    return df.join(verdicts, cond, "left").drop("_g", "_m")
