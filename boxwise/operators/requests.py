"""Chat threads and request rows.

A thread is ``array<struct<role: string, content: string>>``; building and
resetting threads are narrow projections. Requests carry the reference's
parameter set and a deterministic id, so reruns agree.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.functions.text import json_string
from boxwise.operators.sequence import previous_row


# The reference's request parameter defaults.
@dataclass(frozen=True)
class RequestParameters:
    model: str = "gpt-4-1106-preview"
    frequency_penalty: float = 0.0
    presence_penalty: float = 0.0
    temperature: float = 0.0
    max_tokens: int = 2048
    top_p: float = 1.0
    stream: bool = False


def message(role: str, content: str | Column) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), c.cast("string").alias("content"))


def _message_json(role: str, content: Column | str, literal: bool) -> Column:
    """One message as Python's json.dumps writes it; constants are escaped
    once here instead of on every row."""
    head = F.lit('{"role": ' + json.dumps(role) + ', "content": ')
    if literal:
        return F.lit('{"role": ' + json.dumps(role) + ', "content": ' + json.dumps(content) + "}")
    return F.concat(head, F.expr(json_string(f"`{content}`")), F.lit("}"))


def build_threads(df: DataFrame, user_col: str, system_prompt: str | None = None,
                  assistant_col: str | None = None, out: str = "messages") -> DataFrame:
    """[system?] + user [+ assistant] in order.

    Also adds ``<out>_json``, the thread as JSON text, built from the known
    parts so request bodies need no per-row loop over the array.
    """
    msgs, parts = [], []
    if system_prompt:
        msgs.append(message("system", F.lit(system_prompt)))
        parts.append(_message_json("system", system_prompt, True))
    msgs.append(message("user", user_col))
    parts.append(_message_json("user", user_col, False))
    if assistant_col:
        msgs.append(message("assistant", assistant_col))
        parts.append(_message_json("assistant", assistant_col, False))
    pieces = [F.lit("[")]
    for i, p in enumerate(parts):
        pieces += ([F.lit(", ")] if i else []) + [p]
    return df.withColumn(out, F.array(*msgs)).withColumn(f"{out}_json", F.concat(*pieces, F.lit("]")))


def thread_json(messages: str = "messages") -> Column:
    """Any thread column as JSON text (a per-row loop over the array)."""
    return F.expr(
        f"concat('[', array_join(transform(`{messages}`, m -> concat('{{\"role\": ', "
        f"{json_string('m.role')}, ', \"content\": ', {json_string('m.content')}, '}}')), ', '), ']')")


def reset_threads(messages: str = "messages", keep_system: bool = True) -> Column:
    """Keep only a leading system message (or nothing)."""
    if not keep_system:
        return F.expr(f"slice(`{messages}`, 1, 0)")
    return F.filter(messages, lambda m, i: (i == 0) & (m["role"] == "system"))


def last_role_is_assistant(messages: str = "messages") -> Column:
    """P10 on a thread: sending now would follow an assistant message."""
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False))


def role_repeats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """P10 on a message table: turns whose role equals the previous turn's.

    The previous turn comes from ``sequence.previous_row`` (chunked windows),
    so one very long conversation is not a single window partition.
    """
    d = previous_row(df, conv, turn, [role], prefix="_p_").withColumnRenamed(f"_p_{role}", "prev_role")
    return d.withColumn("repeated_role", F.coalesce(F.col(role) == F.col("prev_role"), F.lit(False)))


def request_id(task: str, *cols: str) -> Column:
    """Deterministic id from the task and the row's keys: a whole digest, as
    responses are joined on it. ``short_id`` is for display."""
    return F.md5(F.concat_ws("|", F.lit(task), *[F.col(c).cast("string") for c in cols]))


def short_id(request_id: str = "request_id") -> Column:
    """The first 10 characters, the length that the service's log shows."""
    return F.substring(request_id, 1, 10)


def _py_float(v: float) -> str:
    return repr(float(v))


def build_requests(df: DataFrame, task: str, key_cols: list[str], params: RequestParameters | None = None,
                   messages: str = "messages", **overrides) -> DataFrame:
    """Request rows: ``request_id``, ``params`` struct and ``body_json``
    (the request body as Python's ``json.dumps`` writes it)."""
    p = RequestParameters(**{**asdict(params or RequestParameters()), **overrides})
    params_col = F.struct(*[F.lit(v).alias(k) for k, v in asdict(p).items()])
    head = ", ".join([
        f'"model": {json_dumps_str(p.model)}',
        f'"frequency_penalty": {_py_float(p.frequency_penalty)}',
        f'"presence_penalty": {_py_float(p.presence_penalty)}',
        f'"temperature": {_py_float(p.temperature)}',
        f'"max_tokens": {int(p.max_tokens)}',
        f'"top_p": {_py_float(p.top_p)}',
        f'"stream": {"true" if p.stream else "false"}',
    ])
    msg_json = F.col(f"{messages}_json") if f"{messages}_json" in df.columns else thread_json(messages)
    body = F.concat(F.lit("{" + head + ', "messages": '), msg_json, F.lit("}"))
    return df.select("*", request_id(task, *key_cols).alias("request_id"),
                     params_col.alias("params"), body.alias("body_json"))


def json_dumps_str(s: str) -> str:
    return json.dumps(s)
