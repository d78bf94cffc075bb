"""Text helpers as Spark SQL expression templates (input = SQL text)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxwise.functions.answers import sql_str

_ESC = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escape_printable(t: str) -> str:
    return f"replace(replace({t}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"')"


def json_string(x: str) -> str:
    """Python ``json.dumps(str)`` (``ensure_ascii=True``) byte for byte.

    Printable ASCII only: two replaces. Otherwise the text is cut into runs
    of printable ASCII and single other characters; each other character
    becomes its short escape or ``\\uXXXX`` (UTF-16 code units, lower-case
    hex, surrogate pairs above U+FFFF), as Python writes them.
    """
    arms = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in _ESC.items())
    hexed = "lower(hex(encode(t, 'UTF-16BE')))"
    other = (f"CASE t {arms} ELSE CASE WHEN char_length({hexed}) = 4 THEN concat('\\\\u', {hexed}) "
             f"ELSE concat('\\\\u', substr({hexed}, 1, 4), '\\\\u', substr({hexed}, 5, 4)) END END")
    pieces = f"regexp_extract_all({x}, '(?s)[ -~]+|.', 0)"
    slow = (f"array_join(transform({pieces}, t -> CASE WHEN t RLIKE '^[ -~]' THEN "
            f"{_escape_printable('t')} ELSE {other} END), '')")
    return (f"coalesce(concat('\"', CASE WHEN {x} RLIKE '^[ -~]*\\\\z' THEN {_escape_printable(x)} "
            f"ELSE {slow} END, '\"'), 'null')")


def json_object(fields: list[tuple[str, str]]) -> str:
    """Python ``json.dumps(dict)`` of string values, keys in the given order:
    ``{"k": "v", "k2": "v2"}`` with Python's default separators."""
    parts = []
    for i, (key, expr) in enumerate(fields):
        sep = "" if i == 0 else ", "
        parts.append(sql_str(f'{sep}"{key}": '))
        parts.append(json_string(expr))
    return "concat('{', " + ", ".join(parts) + ", '}')"


def format_columns(fmt: str, columns: dict[str, str]) -> Column:
    """Compile a Python format string (``{name}`` fields, ``{{``/``}}``
    escapes) once on the driver into a ``concat`` of literals and columns."""
    parts = []
    for literal, field, spec, conv in string.Formatter().parse(fmt):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if spec or conv:
                raise ValueError(f"format spec not supported: {{{field}!{conv}:{spec}}}")
            if field not in columns:
                raise KeyError(field)
            parts.append(F.col(columns[field]))
    return F.concat(*parts) if parts else F.lit("")
