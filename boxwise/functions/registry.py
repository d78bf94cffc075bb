"""The answer functions as SQL functions.

``register_sql_functions(spark)`` creates temporary SQL functions whose
bodies are the same native expressions the DataFrame jobs use, so SQL users
get them without a Python UDF:

    SELECT bw_extract_answer(response), bw_answers_match(answer, bw_extract_answer(response))
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from boxwise.functions import answers as A
from boxwise.functions.text import json_string


def _definitions() -> dict[str, tuple[str, str, str]]:
    # name -> (parameter list, return type, body)
    return {
        "bw_extract_box": ("s STRING", "STRING", A.extract_box("s")),
        "bw_extract_answer": ("s STRING", "STRING", A.extract_answer("s")),
        "bw_extraction_method": ("s STRING", "STRING", A.extraction_method("s")),
        "bw_normalize_answer": ("s STRING", "STRING", A.normalize_once("s")),
        "bw_set_equal": ("a STRING, b STRING", "BOOLEAN", A.set_equal("a", "b")),
        "bw_verdict": ("gold_norm STRING, model_norm STRING", "BOOLEAN", A.verdict_once("gold_norm", "model_norm")),
        "bw_answers_match": ("gold STRING, model STRING", "BOOLEAN",
                             "bw_verdict(bw_normalize_answer(gold), bw_normalize_answer(model))"),
        "bw_json_string": ("s STRING", "STRING", json_string("s")),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    names = []
    for name, (params, ret, body) in _definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
        names.append(name)
    return names
