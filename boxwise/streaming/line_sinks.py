"""W1 with several sinks: generated lines to results, rejects and counts.

Each micro-batch is validated once and written to three tables, each in a folder of
its own batch id, which a repeated batch overwrites. The batch is listed in the
manifest after all three are whole, and readers see listed batches only. So a batch
that is run twice adds no row, and one that broke off half-way shows none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.operators import responses
from boxwise.session import cut_lineage, scratch_scope

SINKS = ("results", "rejects", "counts")
MANIFEST = "manifest"
RESPONSES = "task STRING, batch_id BIGINT, content STRING"


def write_batch(batch: DataFrame, micro_batch: int, root: str, add_sol: bool = False, add_ans: bool = True) -> None:
    """One micro-batch of responses (task, batch_id, content) to the sinks below ``root``.

    results: valid lines; rejects: the others with their ``reason``; counts: per task
    the responses, lines and valid lines. A response without content has no lines and
    counts as a response; an empty batch is listed with empty tables."""
    spark = batch.sparkSession

    def put(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/{name}/micro_batch={micro_batch}")

    with scratch_scope(spark):
        lines = cut_lineage(responses.validate_candidates(batch, add_sol, add_ans, outer=True).select(
            "task", "batch_id", "line_no", "line", "valid", "reason"), "sink-lines")
        put(lines.where("valid AND line IS NOT NULL").drop("valid", "reason"), "results")
        put(lines.where("NOT valid AND line IS NOT NULL").drop("valid"), "rejects")
        put(lines.groupBy("task").agg(
            F.count_if(F.coalesce("line_no", F.lit(0)) == 0).alias("responses"), F.count("line").alias("lines"),
            F.count_if(F.col("valid") & F.col("line").isNotNull()).alias("valid")), "counts")
    put(spark.range(1).select(F.current_timestamp().alias("written_at")), MANIFEST)


def run_line_sinks(spark: SparkSession, source_dir: str, root: str, checkpoint_dir: str,
                   add_sol: bool = False, add_ans: bool = True, max_files: int | None = None) -> None:
    """Validates the JSON-lines responses available now, at most ``max_files`` files
    a micro-batch, and stops."""
    source = spark.readStream.schema(RESPONSES)
    if max_files is not None:
        source = source.option("maxFilesPerTrigger", max_files)
    source.json(source_dir).writeStream.foreachBatch(
        lambda batch, number: write_batch(batch, number, root, add_sol, add_ans)).option(
        "checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()


def read_sink(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a sink from the batches that the manifest lists."""
    if name not in SINKS:
        raise ValueError(f"sink must be one of {SINKS}, got {name!r}")
    listed = spark.read.parquet(f"{root}/{MANIFEST}").select("micro_batch").distinct()
    return spark.read.parquet(f"{root}/{name}").join(F.broadcast(listed), "micro_batch", "left_semi").drop("micro_batch")
