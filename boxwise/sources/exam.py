"""The exam question CSV and the exam answer exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.session import cut_lineage


def read_exam_csv(spark: SparkSession, path: str) -> DataFrame:
    """One-column CSV whose cells hold newlines; the column becomes
    ``question``. ``multiLine`` with ``"`` as quote and escape is required:
    default options split the quoted newlines into extra rows."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    first = df.columns[0]
    return df.select(F.col(first).alias("question"))


def write_exam_csv(df: DataFrame, path: str, col: str = "question", header: str = "Question") -> None:
    df.select(F.col(col).alias(header)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def export_exam(df: DataFrame, csv_path: str, jsonl_path: str) -> None:
    """CSV (question, prompt, answer) and JSON lines (answer, question),
    both overwriting earlier output. ``df`` is evaluated once for both."""
    df = cut_lineage(df.select("question", "prompt", "answer"), "exam")
    df.select("question", "prompt", "answer").write.mode("overwrite").csv(
        csv_path, header=True, quote='"', escape='"')
    df.select("answer", "question").write.mode("overwrite").json(jsonl_path)
