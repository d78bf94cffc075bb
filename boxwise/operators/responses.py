"""Resolve request logs, pair responses, split and validate candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwise.functions.answers import py_strip
from boxwise.operators.verify import bind


def _terminal(status: str, body: str):
    """A 200, or a non-200 reply whose text contains '400' (the reference then
    stops and answers with the error text in a box). Null status = transport
    error: retried."""
    st, bd = F.col(status), F.col(body)
    client_err = st.isNotNull() & (st != 200) & F.coalesce(bd.contains("400"), F.lit(False))
    return F.coalesce(st == 200, F.lit(False)) | client_err


def resolve_attempts(log: DataFrame, max_retry: int = 30, request_col: str = "request_id",
                     seq_col: str = "attempt_seq", status_col: str = "status",
                     body_col: str = "body") -> DataFrame:
    """Outcome of each request from its attempt log.

    The log is read once. An attempt counts if fewer than ``max_retry`` attempts
    of its request come before it; the rank limit is applied on each side of the
    exchange, so that a request with a huge log sends at most ``max_retry``
    attempts (and ties) from each partition. Only deciding attempts carry their
    body, and the aggregate that follows keeps the window's partitioning.

    outcome: ``ok`` (first 200 within ``max_retry`` attempts; content = body,
    ``''`` when absent), ``client_error`` (content ``\\boxed{text}``),
    ``failed`` (``max_retry`` attempts without a decision) or ``incomplete``
    (the log ends earlier).
    """
    rid, seq = F.col(request_col), F.col(seq_col)
    term = _terminal(status_col, body_col)
    marked = log.select(rid.alias("request_id"), seq.alias("seq"), term.alias("term"),
                        *[F.when(term, F.col(c)).alias(n) for c, n in ((status_col, "status"), (body_col, "body"))])
    nth = F.rank().over(Window.partitionBy("request_id").orderBy("seq"))
    tried = marked.withColumn("nth", nth).where(F.col("nth") <= max_retry)
    r = tried.groupBy("request_id").agg(
        F.min(F.when(F.col("term"), F.struct("nth", "status", "body"))).alias("t"),
        F.least(F.count(F.lit(1)), F.lit(max_retry)).alias("n_tried"))
    resolved = F.col("t").isNotNull()
    outcome = (F.when(resolved & (F.col("t.status") == 200), F.lit("ok"))
               .when(resolved, F.lit("client_error"))
               .when(F.col("n_tried") >= max_retry, F.lit("failed"))
               .otherwise(F.lit("incomplete")))
    content = (F.when(resolved & (F.col("t.status") == 200), F.coalesce(F.col("t.body"), F.lit("")))
               .when(resolved, F.concat(F.lit("\\boxed{"), F.col("t.body"), F.lit("}"))))
    used = F.when(resolved, F.col("t.nth")).otherwise(F.col("n_tried")).cast("bigint")
    return r.select(F.col("request_id").alias(request_col), outcome.alias("outcome"), content.alias("content"),
                    used.alias("attempts_used"),
                    F.when(resolved, F.col("t.status")).cast("int").alias("final_status"))


def join_responses(requests: DataFrame, responses: DataFrame, key: str = "request_id",
                   how: str = "left") -> DataFrame:
    """Pair outputs with their requests by key (not by position)."""
    return requests.join(responses, key, how)


def split_candidates(df: DataFrame, content_col: str = "content", out: str = "line",
                     outer: bool = False) -> DataFrame:
    """Strip the response, one row per line (``line_no`` from 0). A missing
    response has no lines; ``outer`` keeps it as one row without a line."""
    stripped = F.expr(py_strip(f"`{content_col}`"))
    each = F.posexplode_outer if outer else F.posexplode
    return df.select("*", each(F.split(stripped, "\n", -1)).alias("line_no", out)).drop(content_col)


def _wrapped(doc_col: str, tail: str, size: int):
    """The document parsed as ``[doc<tail>]``, null unless that is an array of
    ``size`` elements."""
    v = F.try_parse_json(F.concat(F.lit("["), F.col(doc_col), F.lit(tail + "]")))
    return F.when(F.array_size(F.try_variant_get(v, "$", "array<variant>")) == size, v)


def parsed_document(df: DataFrame, doc_col: str) -> DataFrame:
    """``df`` with ``_one`` and ``_two``, null unless the document is one JSON value.
    A document without a closing bracket can't close the wrapper, so ``_one`` decides."""
    two = F.when(F.col(doc_col).contains("]"), _wrapped(doc_col, ",0", 2)).otherwise(F.parse_json(F.lit("0")))
    return bind(df, _one=_wrapped(doc_col, "", 1), _two=two)


def json_reason(one: str, two: str, add_sol: bool, add_ans: bool):
    """Why a document is not one JSON object with string fields, null if it is.

    ``one`` and ``two`` are the document parsed as ``[doc]`` and ``[doc,0]``:
    Spark's parser ignores what follows a complete value, so a document could
    close one wrapper itself, but not both in the right way. Types are read
    with ``schema_of_variant`` because ``variant_get(..., 'string')`` would cast.
    """
    v = F.col(one)
    obj = F.schema_of_variant(F.variant_get(v, "$[0]", "variant"))

    def is_str(field):
        return F.coalesce(F.schema_of_variant(F.variant_get(v, f"$[0].{field}", "variant")) == "STRING",
                          F.lit(False))

    reason = F.when(v.isNull() | F.col(two).isNull(), F.lit("not_json"))
    reason = reason.when(~F.coalesce(obj.startswith("OBJECT"), F.lit(False)), F.lit("not_object"))
    reason = reason.when(~is_str("problem"), F.lit("problem_not_string"))
    if add_sol:
        reason = reason.when(~is_str("solution"), F.lit("solution_not_string"))
    if add_ans:
        reason = reason.when(~is_str("answer"), F.lit("answer_not_string"))
    return reason


def validate(df: DataFrame, doc_col: str, add_sol: bool, add_ans: bool) -> DataFrame:
    """Add ``valid`` and ``reason`` (null when valid) for each document. Each step
    sits behind a Generate, so a later filter does not repeat the parsing."""
    df = parsed_document(df, doc_col)
    df = bind(df, reason=json_reason("_one", "_two", add_sol, add_ans)).drop("_one", "_two")
    return df.withColumn("valid", F.col("reason").isNull())


def validate_candidates(df: DataFrame, add_sol: bool = False, add_ans: bool = True,
                        content_col: str = "content", outer: bool = False) -> DataFrame:
    """C4: valid lines of multi-line responses, raw line kept (extra keys too)."""
    return validate(split_candidates(df, content_col, outer=outer), "line", add_sol, add_ans)


def validate_single(df: DataFrame, add_sol: bool = True, add_ans: bool = True,
                    content_col: str = "content", out: str = "doc") -> DataFrame:
    """The whole stripped response is one JSON document."""
    d = df.withColumn(out, F.expr(py_strip(f"`{content_col}`")))
    return validate(d, out, add_sol, add_ans)


def problem_fields(df: DataFrame, doc_col: str) -> DataFrame:
    """Typed ``problem``/``solution``/``answer`` read from valid documents."""
    v = F.try_parse_json(F.col(doc_col))
    return df.select("*", *[F.try_variant_get(v, f"$.{k}", "string").alias(f"gen_{k}")
                            for k in ("problem", "solution", "answer")])


def generation_yield(validated: DataFrame, per_unit: int, unit_col: str,
                     by: tuple[str, ...] = ()) -> DataFrame:
    """Valid outputs against the maximum possible (``per_unit`` per
    batch, 1 per seed, or the per-question cap). Validate with ``outer=True``,
    so that units without a response count too."""
    g = validated.groupBy(*by) if by else validated.groupBy()
    out = g.agg(F.sum(F.col("valid").cast("bigint")).alias("valid"),
                F.countDistinct(unit_col).alias("units"))
    return out.select(*by, F.coalesce("valid", F.lit(0)).cast("bigint").alias("valid"),
                      (F.col("units") * per_unit).cast("bigint").alias("max_valid"),
                      F.round(F.try_divide(F.col("valid"), F.col("units") * per_unit), 4).alias("yield"))
