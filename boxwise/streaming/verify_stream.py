"""Structured Streaming versions of verification and yield counters.

W1 is stateless: new response files are read as they land, answers are
extracted and checked row by row, and results are appended to a Parquet
sink; the checkpoint makes reruns pick up only new files (exactly once per
file). W2 keeps one running row per task (sum of valid, count of lines) in
the streaming state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxwise.operators import responses, verify


def verified_stream(spark: SparkSession, source_dir: str, schema: StructType | str,
                    output_col: str = "response", gold_col: str = "answer") -> DataFrame:
    src = spark.readStream.schema(schema).json(source_dir)
    src = verify.extract_answers(src, output_col, "model_answer")
    # per-row plan: a streaming dedup joined back to its own stream is not supported
    return verify.verify_answers(src, gold_col, "model_answer", "correct", plan="narrow")


def run_verify_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                      schema: StructType | str, output_col: str = "response", gold_col: str = "answer",
                      keep: tuple[str, ...] = ()) -> None:
    """Process everything available now, append to ``sink_dir``, stop."""
    df = verified_stream(spark, source_dir, schema, output_col, gold_col)
    df = df.select(*keep, "model_answer", "correct")
    q = (df.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def yield_counters(lines: DataFrame, per_unit: int, task_col: str = "task") -> DataFrame:
    """W2 aggregate: running valid lines, lines, and the maximum possible per task
    (streaming or batch). ``lines`` come from ``validate_candidates(outer=True)``:
    a unit is a response's first line, or its only row where it is missing."""
    unit = F.coalesce(F.col("line_no"), F.lit(0)) == 0
    return lines.groupBy(task_col).agg(F.sum(F.col("valid").cast("bigint")).alias("valid"),
                                       F.count("line").alias("lines"),
                                       (F.sum(unit.cast("bigint")) * per_unit).alias("max_valid"))


def run_yield_stream(spark: SparkSession, source_dir: str, checkpoint_dir: str, query_name: str,
                     add_sol: bool = False, add_ans: bool = True, per_unit: int = 5) -> DataFrame:
    """Stream of generation responses (``task``, ``batch_id``, ``content``)
    -> validated lines -> per-task counters in complete mode. The sink is an
    in-memory table holding one row per task (bounded by the task count)."""
    src = spark.readStream.schema("task STRING, batch_id BIGINT, content STRING").json(source_dir)
    v = responses.validate_candidates(src, add_sol, add_ans, "content", outer=True)
    q = (yield_counters(v, per_unit).writeStream.format("memory").queryName(query_name)
         .option("checkpointLocation", checkpoint_dir).outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(query_name)
