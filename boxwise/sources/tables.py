"""Driver tables and the deterministic views the jobs run on.

The views stand in for the reference's inputs (seed problems, model outputs,
generated candidates, request logs, instruction pairs); each is a projection
of a driver table, so its size grows with the data. See FIXTURES.md §2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

BS = "\\"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A scan with fewer splits than the cluster has cores
    (a small file is one Parquet row group, hence one task) is spread
    round-robin first, so the CPU-heavy text work that follows is not done
    by one task; a large table already has many splits and is left alone."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed problems (problem_id, problem, solution, answer, subject)."""
    o = load(spark, sf_dir, "orders")
    cust = _s("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("problem_id"),
        F.concat(F.lit("Order "), _s("o_orderkey"), F.lit(" of customer "), cust,
                 F.lit(". Find the customer number.")).alias("problem"),
        F.concat(F.lit(f"It is ${BS}boxed{{"), cust, F.lit("}$.")).alias("solution"),
        cust.alias("answer"),
        F.col("o_orderpriority").alias("subject"),
    )


def attempts(spark: SparkSession, sf_dir: str, per_seed: int = 4) -> DataFrame:
    """Logged model outputs: ``per_seed`` attempts per seed in 10 answer forms."""
    return synthetic_attempts(seeds(spark, sf_dir), per_seed)


def synthetic_attempts(problems: DataFrame, per_seed: int = 4) -> DataFrame:
    """A deterministic solver for any (problem_id, problem, answer) table: the
    same 10 answer forms as ``attempts``. The fan-out is a generator
    (``explode(sequence)``), not a join."""
    s = problems.select("problem_id", "problem", "answer")
    x = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_seed - 1))).alias("attempt"))
    form = ((F.col("problem_id") + F.col("attempt")) % 10).cast("int")
    n = F.col("answer").try_cast("bigint")
    a = F.col("answer")
    forms = [
        F.concat(F.lit(f"so ${BS}boxed{{"), a, F.lit("}$.")),
        F.concat(F.lit("The answer is: "), a),
        F.concat(F.lit("The answer is "), a, F.lit(".")),
        F.concat(F.lit("thus the answer is "), a, F.lit(".")),
        F.concat(F.lit("step 1 gives 17, step 2 gives "), a),
        F.concat(F.lit(f"{BS}boxed{{{BS}frac{{"), _s(2 * n), F.lit("}{2}}")),
        F.concat(F.lit(f"{BS}boxed{{{BS}text{{"), a, F.lit("}}")),
        F.concat(F.lit(f"{BS}boxed{{"), _s(n + 1), F.lit("}")),
        F.concat(F.lit(f"{BS}boxed{{1}} then {BS}boxed{{x="), a, F.lit(" cm}")),
    ]
    resp = F.lit("I cannot solve it")
    for i in reversed(range(len(forms))):
        resp = F.when(form == i, forms[i]).otherwise(resp)
    return x.select("problem_id", "problem", "answer", "attempt", resp.alias("response"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-line generated responses per batch (line 1 valid, line 2 varies)."""
    o = load(spark, sf_dir, "orders")
    cust = _s("o_custkey")
    line1 = F.concat(F.lit('{"problem": "P'), _s("o_orderkey"), F.lit('a", "solution": "S", "answer": "'),
                     cust, F.lit('"}'))
    r = (F.col("o_orderkey") % 6).cast("int")
    line2 = (F.when(r == 0, F.concat(F.lit('{"problem": "Pb", "solution": "S", "answer": '), cust, F.lit("}")))
             .when(r == 1, F.lit('{"problem": "Pb", "solution": "S"}'))
             .when(r == 2, F.lit('{"problem": "Pb", '))
             .when(r == 3, F.lit('["Pb"]'))
             .when(r == 4, F.lit('{"problem": "Pb", "solution": "S", "answer": "1"} trailing'))
             .otherwise(F.lit('{"problem": "Pb", "answer": "1"}')))
    return o.select(F.col("o_orderkey").alias("batch_id"), F.concat_ws("\n", line1, line2).alias("content"))


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request attempts with HTTP-like status (null = transport error)."""
    e = load(spark, sf_dir, "events")
    t = F.col("event_type")
    status = (F.when(t == "purchase", 200).when(t == "error", 500).when(t == "signup", 400)
              .when(t == "click", 429).otherwise(F.lit(None).cast("int")))
    body = (F.when(t == "purchase", F.concat(F.lit("The answer is: "), _s(F.col("event_id") % 7)))
            .when(t == "signup", F.lit("error 400 bad request"))
            .when(t == "error", F.lit("server error"))
            .when(t == "click", F.lit("too many requests"))
            .otherwise(F.lit(None).cast("string")))
    return e.select(
        F.concat(F.lit("u"), _s("user_id"), F.lit("-"), _s(F.floor(F.col("event_id") / 500).cast("bigint"))).alias("request_id"),
        F.col("event_id").alias("attempt_seq"),
        F.col("ts").alias("attempt_ts"),
        status.alias("status"),
        body.alias("body"),
    )


def sft_pairs(spark: SparkSession, sf_dir: str, blank_every: int | None = None) -> DataFrame:
    """(instruction, output) pairs: each assistant turn after a user turn.

    ``blank_every=k`` blanks the instruction where ``conv_id % k = 0`` (to
    exercise the empty-instruction branch of mixed mode).
    """
    from boxwise.operators.sequence import previous_row
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    t = previous_row(c, "conv_id", "turn", ["text", "role"])
    t = t.select("conv_id", "turn", "role", F.col("text").alias("output"),
                 F.col("prev_text").alias("instruction"), F.col("prev_role").alias("prev"))
    t = t.where((F.col("role") == "assistant") & (F.col("prev") == "user"))
    instr = F.col("instruction")
    if blank_every:
        instr = F.when(F.col("conv_id") % blank_every == 0, F.lit("")).otherwise(instr)
    return t.select("conv_id", "turn", instr.alias("instruction"), "output")
