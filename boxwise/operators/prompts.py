"""Prompts, templates, seed serialization and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.functions.answers import py_strip
from boxwise.functions.text import format_columns, json_object, json_string
from boxwise.operators.ordinal import with_ordinal
from boxwise.resources import texts


def instruction_prompt(problem: str | Column = "problem") -> Column:
    """The scoring prompt around a problem."""
    p = F.col(problem) if isinstance(problem, str) else problem
    head, tail = texts.INSTRUCTION_PROMPT.split("{question}")
    return F.concat(F.lit(head), p, F.lit(tail))


def exam_prompt(style: str, question: str = "question", clean: bool = False) -> Column:
    """One of the five exam prompt styles (unknown style: error up front)."""
    if style not in texts.EXAM_STYLES:
        raise ValueError(f"unknown prompt style {style!r}; choose from {sorted(texts.EXAM_STYLES)}")
    fmt = texts.EXAM_STYLES[style]
    if style == "few_shot":
        fmt = fmt.replace("{few_shot}", texts.few_shot_text(clean).replace("{", "{{").replace("}", "}}"))
    return format_columns(fmt, {"question": question})


def exam_prompts(df: DataFrame, style: str = "few_shot", question: str = "question",
                 clean: bool = False) -> DataFrame:
    return df.withColumn("prompt", exam_prompt(style, question, clean))


def render_template(df: DataFrame, template: dict | None = None, instruction: str = "instruction",
                    output: str = "output") -> DataFrame:
    """``prompt``, ``instruction_text``, ``response`` and ``prompt_wo_response``."""
    t = template or texts.load_template()
    cols = {"instruction": instruction, "response": output}
    return df.select("*",
                     format_columns(t["prompt"], cols).alias("prompt"),
                     format_columns(t["instruction"], cols).alias("instruction_text"),
                     format_columns(t["response"], cols).alias("response_text"),
                     format_columns(t["prompt_wo_response"], cols).alias("prompt_wo_response"))


def system_prompt(name: str, num_example: int | None = None, num_generate: int | None = None) -> str:
    """A system prompt; placeholders are filled only when both counts are
    given (batch generation), as the reference does."""
    text = texts.SYSTEM_PROMPTS[name]
    if num_example is not None and num_generate is not None:
        text = text.format(num_example=num_example, num_generate=num_generate)
    return text


def _dropped(add_sol: bool, add_ans: bool) -> list[str]:
    return ([] if add_sol else ["solution"]) + ([] if add_ans else ["answer"])


def prune_fields(df: DataFrame, add_sol: bool, add_ans: bool, fields: tuple[str, ...] | None = None,
                 keys: tuple[str, ...] = ("problem_id",)) -> list[str]:
    """P5: the seed fields sent to the model: all columns but ``keys``, in their
    order, without solution and answer where those are not shown (deleting a
    field that is missing is an error)."""
    fields = fields or tuple(c for c in df.columns if c not in keys)
    missing = [f for f in ("problem", "solution", "answer") if f not in fields]
    if missing:
        raise KeyError(f"seed rows lack {missing}")
    return [f for f in fields if f not in _dropped(add_sol, add_ans)]


def seed_json(df: DataFrame, add_sol: bool, add_ans: bool, out: str = "seed_json",
              fields: tuple[str, ...] | None = None, keys: tuple[str, ...] = ("problem_id",)) -> DataFrame:
    """The pruned seed as Python would write it (``json.dumps``)."""
    keep = prune_fields(df, add_sol, add_ans, fields, keys)
    return df.withColumn(out, F.expr(json_object([(k, f"`{k}`") for k in keep])))


def raw_seed_json(raw: str, add_sol: bool, add_ans: bool) -> Column:
    """P5 and P7 on a raw JSON line: all its keys in file order but the pruned
    ones. Strings are written as Python writes them; numbers, lists and objects
    as Spark's ``to_json`` does (no blanks inside)."""
    entries = f"map_entries(from_json({py_strip(f'`{raw}`')}, 'MAP<STRING, VARIANT>'))"
    for name in _dropped(add_sol, add_ans):
        entries = f"filter({entries}, e -> e.key <> '{name}')"
    text = json_string("variant_get(e.value, '$', 'string')")
    items = (f"transform({entries}, e -> concat({json_string('e.key')}, ': ', "
             f"CASE WHEN schema_of_variant(e.value) = 'STRING' THEN {text} ELSE to_json(e.value) END))")
    return F.expr(f"concat('{{', array_join({items}, ', '), '}}')")


def batch_seeds(df: DataFrame, num_example: int, add_sol: bool = False, add_ans: bool = True,
                order_col: str = "problem_id", raw_col: str | None = None) -> DataFrame:
    """Consecutive ``num_example`` seeds per batch; the short last batch is
    dropped; user prompt = their JSON lines joined by newlines.

    Returns (batch_id, first_id, user_prompt). With one seed per batch the seed's
    own key is the batch id, and no order is needed; larger batches group on a
    bounded key (n rows each). ``raw_col`` names a column with the seeds' raw JSON
    lines, whose extra keys are then sent as they are.
    """
    s = df.withColumn("seed_json", raw_seed_json(raw_col, add_sol, add_ans)) if raw_col else \
        seed_json(df, add_sol, add_ans, keys=(order_col,))
    if num_example == 1:
        return s.select(F.col(order_col).alias("batch_id"), F.col(order_col).alias("first_id"),
                        F.col("seed_json").alias("user_prompt"))
    s = with_ordinal(s.select(order_col, "seed_json"), [order_col], "_ord")
    s = s.withColumn("batch_id", F.floor(F.col("_ord") / num_example).cast("bigint"))
    g = s.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_list(F.struct("_ord", F.col(order_col).alias("id"), "seed_json"))).alias("_items"))
    return g.where(F.col("_n") == num_example).select(
        "batch_id", F.col("_items")[0]["id"].alias("first_id"),
        F.array_join(F.transform("_items", lambda x: x["seed_json"]), "\n").alias("user_prompt"))
