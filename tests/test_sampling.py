"""Rejection sampling against a brute-force copy of the sequential loop."""
import random

import pytest
from pyspark.sql import functions as F

from boxwise.operators import sampling


def sequential(attempts, num_sample, cap):
    """The reference's per-question loop, written plainly."""
    kept, used = [], 0
    for i, ok in enumerate(attempts[:num_sample]):
        used += 1
        if ok:
            kept.append(i)
        if len(kept) >= cap:
            break
    return kept, used


@pytest.fixture(scope="module")
def attempts_df(spark):
    rnd = random.Random(7)
    rows = [(q, a, rnd.random() < 0.45) for q in range(60) for a in range(rnd.randint(1, 6))]
    return rows, spark.createDataFrame(rows, "problem_id long, attempt int, correct boolean")


@pytest.mark.parametrize("num_sample,cap", [(3, 3), (4, 1), (5, 2), (3, 0), (2, 5)])
def test_reject_sample_matches_loop(attempts_df, num_sample, cap):
    rows, df = attempts_df
    got = sorted((r.problem_id, r.attempt) for r in sampling.reject_sample(df, num_sample, cap).collect())
    by_q = {}
    for q, a, ok in rows:
        by_q.setdefault(q, []).append(ok)
    want = sorted((q, i) for q, oks in by_q.items() for i in sequential(oks, num_sample, cap)[0])
    assert got == want
    per_q = {}
    for q, _ in got:
        per_q[q] = per_q.get(q, 0) + 1
    assert all(v <= max(cap, 1) for v in per_q.values())


@pytest.mark.parametrize("num_sample,cap", [(3, 3), (4, 1), (3, 0)])
def test_attempts_consumed_matches_loop(attempts_df, num_sample, cap):
    rows, df = attempts_df
    got = {r.problem_id: (r.attempts_used, r.kept) for r in sampling.attempts_consumed(df, num_sample, cap).collect()}
    by_q = {}
    for q, a, ok in rows:
        by_q.setdefault(q, []).append(ok)
    for q, oks in by_q.items():
        kept, used = sequential(oks, num_sample, cap)
        assert got[q] == (used, len(kept)), q
