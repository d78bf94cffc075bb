"""V1, V2: rejection sampling over logged attempts.

The reference asks a model up to ``num_sample_1q`` times per question and
keeps correct solutions until ``max_valid_1q`` are kept. Over a table of
attempts (``attempt`` = 0-based try index per question) the same rows are:

* ``cap >= num_sample``: every correct attempt among the first ``num_sample``
  -- a narrow filter, no shuffle (the default 3/3 is this case);
* ``1 <= cap < num_sample``: correct attempts whose running count of correct
  ones is at most ``cap`` -- one window per question, bounded by
  ``num_sample`` rows because the filter on ``attempt`` runs first;
* ``cap <= 0``: the reference checks the cap after appending, so a correct
  first attempt is still kept and nothing after it is tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reject_sample(attempts: DataFrame, num_sample_1q: int = 3, max_valid_1q: int = 3,
                  key: str | list[str] = "problem_id", attempt_col: str = "attempt",
                  correct_col: str = "correct") -> DataFrame:
    """V1: the attempts a sequential sampler would keep."""
    a = attempts.where(F.col(attempt_col) < num_sample_1q)
    if max_valid_1q <= 0:
        return a.where(F.col(correct_col) & (F.col(attempt_col) == 0))
    if max_valid_1q >= num_sample_1q:
        return a.where(F.col(correct_col))
    keys = [key] if isinstance(key, str) else list(key)
    w = (Window.partitionBy(*keys).orderBy(attempt_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = F.sum(F.col(correct_col).cast("int")).over(w)
    return (a.withColumn("_kept_so_far", running)
            .where(F.col(correct_col) & (F.col("_kept_so_far") <= max_valid_1q))
            .drop("_kept_so_far"))


def attempts_consumed(attempts: DataFrame, num_sample_1q: int = 3, max_valid_1q: int = 3,
                      key: str = "problem_id", attempt_col: str = "attempt",
                      correct_col: str = "correct") -> DataFrame:
    """V2: per question, attempts used and solutions kept by a sequential sampler.

    The stop point is the ``cap``-th correct attempt; its index comes from a
    per-question list of correct attempt indexes, which the filter on
    ``attempt`` bounds by ``num_sample`` entries.
    """
    a = attempts.where(F.col(attempt_col) < num_sample_1q)
    cap = max(max_valid_1q, 0)
    agg = a.groupBy(key).agg(
        F.count(F.lit(1)).alias("_logged"),
        F.sum(F.col(correct_col).cast("int")).alias("_n_correct"),
        F.array_sort(F.collect_list(F.when(F.col(correct_col), F.col(attempt_col)))).alias("_ok"),
        F.max(F.when((F.col(attempt_col) == 0) & F.col(correct_col), 1).otherwise(0)).alias("_first_ok"),
    )
    if cap == 0:
        used = F.lit(1).cast("bigint")
        kept = F.col("_first_ok").cast("bigint")
    else:
        stop = F.try_element_at("_ok", F.lit(cap))
        used = F.coalesce(stop + 1, F.least(F.col("_logged"), F.lit(num_sample_1q))).cast("bigint")
        kept = F.least(F.col("_n_correct"), F.lit(cap)).cast("bigint")
    return agg.select(key, used.alias("attempts_used"), kept.alias("kept"))
