"""Where model text comes from.

The reference calls a chat service; this library ships no network code.
A provider turns request rows into response text:

* ``replay``: join recorded responses on a key (the normal batch path);
* ``synthetic``: a deterministic column expression over the request row
  (for tests and for replaying documented behaviour).

A user who must call a live service can pass any function
``requests_df -> responses_df`` (for example a ``mapInPandas`` over batches
of requests); the rest of the jobs do not change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.functions.text import json_object

Provider = Callable[[DataFrame], DataFrame]


def replay(responses: DataFrame, left_on: str, right_on: str, content_col: str = "content",
           out: str = "content") -> Provider:
    """Pair each request with its recorded response (left join: a missing
    response stays visible as null)."""
    r = responses.select(F.col(right_on).alias("_rk"), F.col(content_col).alias(out))

    def run(requests: DataFrame) -> DataFrame:
        return requests.join(r, requests[left_on] == r["_rk"], "left").drop("_rk")
    return run


def synthetic(expr: Callable[[], Column], out: str = "content") -> Provider:
    def run(requests: DataFrame) -> DataFrame:
        return requests.withColumn(out, expr())
    return run


PROVIDERS: dict[str, Provider] = {}


def register_provider(name: str, provider: Provider) -> None:
    """Make a provider known by name; the named jobs take either."""
    PROVIDERS[name] = provider


def get_provider(provider: str | Provider) -> Provider:
    if callable(provider):
        return provider
    if provider not in PROVIDERS:
        raise KeyError(f"unknown provider {provider!r}; registered: {sorted(PROVIDERS)}")
    return PROVIDERS[provider]


def compose_one_step(problem: str = "problem", answer: str = "answer") -> Column:
    """A deterministic "composer": the parent problem plus one more step,
    answered with parent answer + 1, as the JSON a model would return.
    Parents without an integer answer get a refusal (invalid JSON)."""
    nxt = (F.col(answer).try_cast("bigint") + 1).cast("string")
    doc = F.expr(json_object([
        ("problem", f"concat(`{problem}`, ' Then add 1 to the result.')"),
        ("solution", f"concat('Add one: $\\\\boxed{{', CAST(try_cast(`{answer}` AS BIGINT) + 1 AS STRING), '}}$.')"),
        ("answer", f"CAST(try_cast(`{answer}` AS BIGINT) + 1 AS STRING)"),
    ]))
    return F.when(nxt.isNotNull(), doc).otherwise(F.lit("Sorry, I cannot compose a problem from this one."))
