"""Newline-delimited JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxwise.functions.answers import py_strip
from boxwise.operators import responses
from boxwise.operators.ordinal import with_ordinal


def read_lines(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    """Lines of text files with their 0-based position in file order.

    The order key is (file path, split start, row index inside the split);
    ``with_ordinal`` turns it into a global line number without moving all
    lines to one task.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"))
    if skip_blank:
        raw = raw.where(F.expr(py_strip("value")) != "")
    lines = with_ordinal(raw, ["_f", "_b", "_i"], "line_no").drop("_f", "_b", "_i")
    if skip_blank:
        return lines
    # blank lines at either end are no lines
    ends = lines.where(F.expr(py_strip("value")) != "").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b")).first()
    if ends.a is None:
        return lines.limit(0)
    return lines.where(F.col("line_no").between(ends.a, ends.b)).withColumn("line_no", F.col("line_no") - ends.a)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None,
               start: int = 0, end: int | None = None, skip_blank: bool = True,
               keep_raw: bool = False, strict: bool = False) -> DataFrame:
    """Parse JSON lines and keep ``[start:end]`` by line number, with
    Python slice rules (negative bounds count from the end). ``strict``: a line
    that is not one JSON object fails the job, with its number."""
    lines = read_lines(spark, path, skip_blank)
    if (start is not None and start < 0) or (end is not None and end < 0):
        total = lines.count()
        start = max(total + start, 0) if start is not None and start < 0 else start
        end = max(total + end, 0) if end is not None and end < 0 else end
    cond = F.col("line_no") >= (start or 0)
    if end is not None:
        cond = cond & (F.col("line_no") < end)
    lines = lines.where(cond)
    if schema is None:
        return lines
    if strict:
        reason = F.concat(F.lit("malformed JSON on line "), F.col("line_no").cast("string"), F.lit(": "), F.col("value"))
        lines = not_objects(lines).withColumn(
            "value", F.when(F.col("malformed"), F.raise_error(reason).cast("string")).otherwise(F.col("value"))).drop("malformed")
    parsed = lines.select("line_no", *(["value"] if keep_raw else []),
                          F.from_json(F.expr(py_strip("value")), schema).alias("_j"))
    return parsed.select("line_no", *(["value"] if keep_raw else []), "_j.*")


def not_objects(lines: DataFrame, col: str = "value") -> DataFrame:
    """``lines`` with ``malformed``: whether the line is not one JSON object."""
    checked = responses.parsed_document(lines, col)
    kind = F.schema_of_variant(F.variant_get("_one", "$[0]", "variant"))
    good = F.col("_one").isNotNull() & F.col("_two").isNotNull() & F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return checked.withColumn("malformed", ~good).drop("_one", "_two")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; reruns add rows, as the reference's
    append-mode files do."""
    df.write.mode("append").json(path)


def write_text_lines(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(col).alias("value")).write.mode(mode).text(path)
