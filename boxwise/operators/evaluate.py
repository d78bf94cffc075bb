"""V3-V5: scoring model outputs against gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.operators.verify import extract_answers, verify_answers

EVAL_COLUMNS = ["correct", "answer", "model_answer", "problem", "solution", "model_solution"]


def eval_rows(df: DataFrame, output_col: str = "model_solution", keys: tuple[str, ...] = (),
              plan: str = "narrow") -> DataFrame:
    """V3: one scored row per item: ``correct, answer, model_answer, problem,
    solution, model_solution`` (plus any key columns)."""
    if output_col != "model_solution":
        df = df.withColumnRenamed(output_col, "model_solution")
    df = extract_answers(df, "model_solution", "model_answer")
    df = verify_answers(df, "answer", "model_answer", "correct", plan=plan)
    return df.select(*keys, *EVAL_COLUMNS)


def accuracy(scored: DataFrame, correct_col: str = "correct", by: tuple[str, ...] = ()) -> DataFrame:
    """V4: correct, total and their ratio to 4 places (null when no rows)."""
    agg = (scored.groupBy(*by) if by else scored.groupBy())
    out = agg.agg(F.sum(F.col(correct_col).cast("bigint")).alias("num_correct"),
                  F.count(F.lit(1)).alias("total"))
    return out.select(*by, F.coalesce("num_correct", F.lit(0)).cast("bigint").alias("num_correct"),
                      "total", F.round(F.try_divide("num_correct", "total"), 4).alias("accuracy"))


def exam_answers(questions: DataFrame, provider, style: str = "few_shot",
                 question: str = "question") -> DataFrame:
    """V5: questions with their prompt and the provider's answer (not scored)."""
    from boxwise.operators.prompts import exam_prompts
    return provider(exam_prompts(questions, style, question))
