"""Registered queries: one Spark plan per operator, each with its DuckDB oracle.

Each query reads the driver tables at ``sf_dir`` (through the views of
``boxwise.sources.tables``) and returns a DataFrame; ``ORACLE[name]`` is the
same result in DuckDB SQL over the same parquet tables, or absent when only
a row-count check is possible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions import answers as A
from boxwise.operators import evaluate, sampling, verify
from boxwise.plans import oracle as O
from boxwise.session import cut_lineage, scratch_path
from boxwise.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _with(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


# ---------------------------------------------------------------------------
# 2.4 Answers
# ---------------------------------------------------------------------------
_EXTRACTED = (f"SELECT problem_id, attempt, problem, answer, response, "
              f"{O.extract_answer('response')} AS model_answer FROM attempts")
_NORMED = ("SELECT *, " + O.normalize("answer") + " AS gold_norm, "
           + O.normalize("model_answer") + " AS model_norm FROM extracted")
_VERDICTS = "SELECT *, " + O.verdict("gold_norm", "model_norm") + " AS correct FROM normed"
_SCORED_CTES = dict(attempts=O.ATTEMPTS, extracted=_EXTRACTED, normed=_NORMED, scored=_VERDICTS)


def scored_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.attempts(spark, sf_dir)
    a = verify.extract_answers(a, "response", "model_answer")
    return verify.verify_answers(a, "answer", "model_answer", "correct")


@register("extract_box", _with(attempts=O.ATTEMPTS) +
          f"SELECT problem_id, attempt, {O.extract_box('response')} AS boxed FROM attempts "
          "WHERE contains(response, 'boxed')")
def q_extract_box(spark, sf_dir):
    a = T.attempts(spark, sf_dir).where(F.col("response").contains("boxed"))
    return a.select("problem_id", "attempt", A.col_extract_box("response").alias("boxed"))


@register("locate_box", _with(attempts=O.ATTEMPTS) +
          "SELECT problem_id, attempt, "
          "CASE WHEN contains(response, '\\boxed') AND left(string_split(response, '\\boxed')[-1], 1) = '{' "
          "THEN CAST(length(response) - length(string_split(response, '\\boxed')[-1]) + 2 AS INT) END AS box_pos, "
          "CASE WHEN contains(response, '\\boxed') AND left(string_split(response, '\\boxed')[-1], 1) = '{' "
          "THEN CAST(length(" + O.extract_box("response") + ") AS INT) END AS box_len FROM attempts")
def q_locate_box(spark, sf_dir):
    a = T.attempts(spark, sf_dir).withColumn("_loc", A.col_locate_box("response"))
    return a.select("problem_id", "attempt", F.col("_loc.pos").alias("box_pos"),
                    F.col("_loc.len").alias("box_len"))


@register("extract_answer", _with(attempts=O.ATTEMPTS) +
          f"SELECT problem_id, attempt, {O.extract_answer('response')} AS model_answer FROM attempts")
def q_extract_answer(spark, sf_dir):
    a = verify.extract_answers(T.attempts(spark, sf_dir), "response", "model_answer")
    return a.select("problem_id", "attempt", "model_answer")


@register("extraction_method_counts", _with(attempts=O.ATTEMPTS) +
          f"SELECT {O.extraction_method('response')} AS method, count(*)::BIGINT AS n FROM attempts GROUP BY 1")
def q_method_counts(spark, sf_dir):
    return verify.extraction_method_counts(T.attempts(spark, sf_dir), "response")


@register("normalize_answer", _with(attempts=O.ATTEMPTS, extracted=_EXTRACTED) +
          f"SELECT problem_id, attempt, {O.normalize('model_answer')} AS model_norm FROM extracted")
def q_normalize(spark, sf_dir):
    a = verify.extract_answers(T.attempts(spark, sf_dir), "response", "model_answer")
    return verify.normalize(a, "model_answer", "model_norm").select("problem_id", "attempt", "model_norm")


# Mixed numbers built from the seeds: "<attempt+1>\frac{<answer>}{<problem_id % 97 + 1>}"
_MIXED_IN = ("concat(CAST(attempt + 1 AS VARCHAR), chr(92), 'frac{', answer, '}{', "
             "CAST(problem_id % 97 + 1 AS VARCHAR), '} and ', answer, chr(92), 'frac{1}{2}')")


@register("mixed_numbers", _with(attempts=O.ATTEMPTS) +
          f"SELECT problem_id, attempt, {O.mixed('mixed_in')} AS mixed FROM (SELECT *, {_MIXED_IN} AS mixed_in FROM attempts)")
def q_mixed(spark, sf_dir):
    a = T.attempts(spark, sf_dir)
    a = a.withColumn("mixed_in", F.concat(
        (F.col("attempt") + 1).cast("string"), F.lit("\\frac{"), F.col("answer"), F.lit("}{"),
        (F.col("problem_id") % 97 + 1).cast("string"), F.lit("} and "), F.col("answer"), F.lit("\\frac{1}{2}")))
    return a.select("problem_id", "attempt", F.expr(A.mixed_numbers("mixed_in")).alias("mixed"))


@register("set_equal", _with(**{k: v for k, v in _SCORED_CTES.items() if k != "scored"}) +
          f"SELECT problem_id, attempt, ({O.answer_set('model_norm')} = {O.answer_set('gold_norm')}) AS set_equal FROM normed")
def q_set_equal(spark, sf_dir):
    a = verify.extract_answers(T.attempts(spark, sf_dir), "response", "model_answer")
    a = verify.normalize_pair(a, "answer", "model_answer")
    return a.select("problem_id", "attempt", A.col_set_equal("model_norm", "gold_norm").alias("set_equal"))


@register("value_equal", _with(**{k: v for k, v in _SCORED_CTES.items() if k != "scored"}) +
          f"SELECT problem_id, attempt, {O.rat_eq(O.rational('model_norm'), O.rational('gold_norm'))} AS value_equal FROM normed")
def q_value_equal(spark, sf_dir):
    a = verify.extract_answers(T.attempts(spark, sf_dir), "response", "model_answer")
    a = verify.normalize_pair(a, "answer", "model_answer")
    a = a.withColumn("rm", A.col_rational("model_norm")).withColumn("rg", A.col_rational("gold_norm"))
    return a.select("problem_id", "attempt", F.expr(A.rational_equal("rm", "rg")).alias("value_equal"))


# Tuples built from each attempt: "(<answer>,<attempt>)" against "(<model answer>,<attempt>.0)".
_TUPLE_G = "concat('(', answer, ',', CAST(attempt AS VARCHAR), ')')"
_TUPLE_M = "concat('(', model_answer, ',', CAST(attempt AS VARCHAR), '.0)')"


@register("tuple_equal", _with(attempts=O.ATTEMPTS, extracted=_EXTRACTED) +
          "SELECT problem_id, attempt, " + O.verdict("tg", "tm").replace(
              "(" + O.answer_set("tm") + " = " + O.answer_set("tg") + ") OR ", "") +
          f" AS tuple_equal FROM (SELECT *, {_TUPLE_G} AS tg, {_TUPLE_M} AS tm FROM extracted)")
def q_tuple_equal(spark, sf_dir):
    a = verify.extract_answers(T.attempts(spark, sf_dir), "response", "model_answer")
    a = a.withColumn("tg", F.expr(_TUPLE_G.replace("VARCHAR", "STRING"))) \
         .withColumn("tm", F.expr(_TUPLE_M.replace("VARCHAR", "STRING")))
    return a.select("problem_id", "attempt",
                    F.expr(f"coalesce({A.second_chance('tg', 'tm')}, false)").alias("tuple_equal"))


@register("verify_answers", _with(**_SCORED_CTES) + "SELECT problem_id, attempt, correct FROM scored")
def q_verify(spark, sf_dir):
    return scored_attempts(spark, sf_dir).select("problem_id", "attempt", "correct")


@register("verify_answers_distinct", _with(**_SCORED_CTES) + "SELECT problem_id, attempt, correct FROM scored")
def q_verify_distinct(spark, sf_dir):
    a = verify.extract_answers(T.attempts(spark, sf_dir), "response", "model_answer")
    a = a.select("problem_id", "attempt", "answer", "model_answer")
    return verify.verify_answers(a, "answer", "model_answer", "correct", plan="distinct").select(
        "problem_id", "attempt", "correct")


# Missing answers, and numbers that are no ASCII digits, on either side of a slash.
_ODD_ANSWERS = {0: None, 1: "x\u00b2/2", 2: "\u00bd/3", 3: "3\u00b2/4", 4: "x=\u00e9/2"}


@register("verify_odd_answers", _with(attempts=O.ATTEMPTS, extracted="SELECT problem_id, attempt, CASE problem_id % 9 "
          + " ".join(f"WHEN {k} THEN {'NULL' if v is None else O.lit(v)}" for k, v in _ODD_ANSWERS.items())
          + " ELSE answer END AS answer, CASE (problem_id + attempt) % 8 "
          + " ".join(f"WHEN {k} THEN {'NULL' if v is None else O.lit(v)}" for k, v in _ODD_ANSWERS.items())
          + " ELSE response END AS model_answer FROM attempts", normed=_NORMED)
          + "SELECT problem_id, attempt, model_norm, coalesce(" + O.verdict("gold_norm", "model_norm") + ", false) AS correct FROM normed")
def q_verify_odd(spark, sf_dir):
    def odd(key, other):
        out = F.when(F.lit(False), F.lit(""))
        for k, v in _ODD_ANSWERS.items():
            out = out.when(key == k, F.lit(v).cast("string"))
        return out.otherwise(F.col(other))
    a = T.attempts(spark, sf_dir).withColumn("answer", odd(F.col("problem_id") % 9, "answer")) \
        .withColumn("model_answer", odd((F.col("problem_id") + F.col("attempt")) % 8, "response"))
    a = verify.verify_answers(a, "answer", "model_answer", "correct", keep_normalized=True)
    return a.select("problem_id", "attempt", "model_norm", "correct")


# ---------------------------------------------------------------------------
# 2.5 Sampling and evaluation
# ---------------------------------------------------------------------------
MODEL = "gpt-3.5-turbo"


@register("accuracy", _with(**_SCORED_CTES) +
          "SELECT sum(correct::INT)::BIGINT AS num_correct, count(*)::BIGINT AS total, "
          "round(sum(correct::INT) / count(*), 4) AS accuracy FROM scored")
def q_accuracy(spark, sf_dir):
    return evaluate.accuracy(scored_attempts(spark, sf_dir))


@register("reject_sample", _with(**_SCORED_CTES) +
          f"SELECT problem_id, attempt, problem, response AS solution, answer, '{MODEL}' AS source "
          "FROM scored WHERE attempt < 3 AND correct")
def q_reject_sample(spark, sf_dir):
    kept = sampling.reject_sample(scored_attempts(spark, sf_dir), 3, 3)
    return kept.select("problem_id", "attempt", "problem", F.col("response").alias("solution"),
                       "answer", F.lit(MODEL).alias("source"))


@register("reject_sample_capped", _with(**_SCORED_CTES) +
          f"SELECT problem_id, attempt, problem, response AS solution, answer, '{MODEL}' AS source FROM ("
          "SELECT *, sum(correct::INT) OVER (PARTITION BY problem_id ORDER BY attempt "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM scored WHERE attempt < 4) t "
          "WHERE correct AND run <= 1")
def q_reject_sample_capped(spark, sf_dir):
    kept = sampling.reject_sample(scored_attempts(spark, sf_dir), 4, 1)
    return kept.select("problem_id", "attempt", "problem", F.col("response").alias("solution"),
                       "answer", F.lit(MODEL).alias("source"))


@register("attempts_consumed", _with(**_SCORED_CTES) +
          "SELECT problem_id, coalesce(min(CASE WHEN correct AND run = 1 THEN attempt END) + 1, "
          "least(count(*), 4))::BIGINT AS attempts_used, least(sum(correct::INT), 1)::BIGINT AS kept FROM ("
          "SELECT *, sum(correct::INT) OVER (PARTITION BY problem_id ORDER BY attempt "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM scored WHERE attempt < 4) t "
          "GROUP BY problem_id")
def q_attempts_consumed(spark, sf_dir):
    return sampling.attempts_consumed(scored_attempts(spark, sf_dir), 4, 1)


@register("eval_rows", _with(seeds=O.SEEDS, **_SCORED_CTES) +
          "SELECT s.problem_id, a.attempt, a.correct, s.answer, a.model_answer, s.problem, s.solution, "
          "a.response AS model_solution FROM seeds s JOIN scored a ON s.problem_id = a.problem_id")
def q_eval_rows(spark, sf_dir):
    items = T.seeds(spark, sf_dir).select("problem_id", "problem", "solution", "answer")
    outs = T.attempts(spark, sf_dir).select("problem_id", "attempt", F.col("response").alias("model_solution"))
    # a merge join: by the size of its compressed file, the table may be broadcast although the driver can't hold it
    return evaluate.eval_rows(items.hint("merge").join(outs, "problem_id"), keys=("problem_id", "attempt"))


# ---------------------------------------------------------------------------
# 2.2 Prompts, templates, requests
# ---------------------------------------------------------------------------
from boxwise.functions import text as TX  # noqa: E402
from boxwise.operators import prompts as P  # noqa: E402
from boxwise.operators import requests as R  # noqa: E402
from boxwise.operators import responses as C  # noqa: E402
from boxwise.resources import texts  # noqa: E402

NL2 = "chr(10) || chr(10)"


@register("instruction_prompt", _with(seeds=O.SEEDS) +
          f"SELECT problem_id, {O.lit(texts.INSTRUCTION_PROMPT.split('{question}')[0])} || problem || {NL2} "
          "AS prompt FROM seeds")
def q_instruction_prompt(spark, sf_dir):
    return T.seeds(spark, sf_dir).select("problem_id", P.instruction_prompt("problem").alias("prompt"))


def _exam_sql(style: str) -> str:
    fmt = texts.EXAM_STYLES[style]
    if style == "few_shot":
        fmt = fmt.replace("{few_shot}", texts.few_shot_text())
    head, tail = fmt.split("{question}")
    return f"SELECT item_id, '{style}' AS style, {O.lit(head)} || text || {O.lit(tail)} AS prompt FROM benchmark"


@register("exam_prompts", " UNION ALL ".join(_exam_sql(s) for s in texts.EXAM_STYLES))
def q_exam_prompts(spark, sf_dir):
    b = T.load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    parts = [b.select("item_id", F.lit(s).alias("style"), P.exam_prompt(s, "question").alias("prompt"))
             for s in texts.EXAM_STYLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("render_template", _with(sp=O.SFT_PAIRS) +
          f"SELECT conv_id, turn, instruction || {NL2} || output AS prompt, instruction AS instruction_text, "
          f"output AS response_text, instruction || {NL2} AS prompt_wo_response FROM sp")
def q_render_template(spark, sf_dir):
    return P.render_template(T.sft_pairs(spark, sf_dir)).drop("instruction", "output")


@register("serialize_user_prompt", _with(seeds=O.SEEDS) +
          "SELECT problem_id, " + O.json_object([("problem", "problem"), ("answer", "answer"), ("subject", "subject")]) +
          " AS user_prompt FROM seeds")
def q_serialize(spark, sf_dir):
    s = P.seed_json(T.seeds(spark, sf_dir), add_sol=False, add_ans=True, out="user_prompt")
    return s.select("problem_id", "user_prompt")


@register("serialize_pairs", _with(sp=O.SFT_PAIRS) +
          "SELECT conv_id, turn, " + O.json_object([("instruction", "instruction"), ("output", "output")]) +
          " AS line FROM sp")
def q_serialize_pairs(spark, sf_dir):
    sp = T.sft_pairs(spark, sf_dir)
    return sp.select("conv_id", "turn", F.expr(TX.json_object([("instruction", "instruction"),
                                                               ("output", "output")])).alias("line"))


_SEED_JSON3 = O.json_object([("problem", "problem"), ("solution", "solution"), ("answer", "answer"),
                             ("subject", "subject")])


@register("batch_seeds", _with(seeds=O.SEEDS) +
          "SELECT batch_id, min(problem_id) AS first_id, string_agg(js, chr(10) ORDER BY k) AS user_prompt FROM ("
          f"SELECT problem_id, {_SEED_JSON3} AS js, row_number() OVER (ORDER BY problem_id) - 1 AS k, "
          "CAST(floor((row_number() OVER (ORDER BY problem_id) - 1) / 3) AS BIGINT) AS batch_id FROM seeds) t "
          "GROUP BY batch_id HAVING count(*) = 3")
def q_batch_seeds(spark, sf_dir):
    return P.batch_seeds(T.seeds(spark, sf_dir), 3, add_sol=True, add_ans=True)


def _thread_json_sql(roles_contents: list[tuple[str, str]]) -> str:
    items = [f"'{{\"role\": ' || {O.json_string(r)} || ', \"content\": ' || {O.json_string(c)} || '}}'"
             for r, c in roles_contents]
    return "('[' || " + " || ', ' || ".join(items) + " || ']')"


_COT = texts.SYSTEM_PROMPTS["cot"]
_THREAD3 = _thread_json_sql([("'system'", O.lit(_COT)), ("'user'", "problem"), ("'assistant'", "response")])


def _threads(spark, sf_dir):
    a = T.attempts(spark, sf_dir)
    return R.build_threads(a, "problem", _COT, "response")


def _thread_json_col(messages: str = "messages"):
    return R.thread_json(messages)


@register("build_threads", _with(attempts=O.ATTEMPTS) +
          f"SELECT problem_id, attempt, 'system,user,assistant' AS roles, {_THREAD3} AS thread_json FROM attempts")
def q_build_threads(spark, sf_dir):
    t = _threads(spark, sf_dir)
    return t.select("problem_id", "attempt",
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    F.col("messages_json").alias("thread_json"))


@register("reset_threads", _with(attempts=O.ATTEMPTS) +
          f"SELECT problem_id, attempt, 1::BIGINT AS n_kept, 'system' AS roles, "
          f"{_thread_json_sql([(chr(39) + 'system' + chr(39), O.lit(_COT))])} AS thread_json FROM attempts")
def q_reset_threads(spark, sf_dir):
    t = _threads(spark, sf_dir).withColumn("messages", R.reset_threads("messages"))
    return t.select("problem_id", "attempt", F.size("messages").cast("bigint").alias("n_kept"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    _thread_json_col().alias("thread_json"))


@register("role_sequence_check",
          "WITH c AS (SELECT false AS doctored, * FROM conversations UNION ALL "
          "SELECT true AS doctored, * FROM conversations WHERE NOT (role = 'user' AND turn = 2)) "
          "SELECT doctored, conv_id, turn, role, coalesce(role = lag(role) OVER (PARTITION BY doctored, conv_id "
          "ORDER BY turn), false) AS repeated_role FROM c")
def q_role_check(spark, sf_dir):
    """The whole table, and a copy without the user turns numbered 2, whose
    assistant turns then follow each other."""
    c = T.load(spark, sf_dir, "conversations")
    cut = c.where(~((F.col("role") == "user") & (F.col("turn") == 2)))
    both = c.withColumn("doctored", F.lit(False)).unionByName(cut.withColumn("doctored", F.lit(True)))
    both = both.withColumn("thread", F.struct("doctored", "conv_id"))
    return R.role_repeats(both, conv="thread").select("doctored", "conv_id", "turn", "role", "repeated_role")


_BODY_HEAD = ('{"model": "gpt-3.5-turbo", "frequency_penalty": 0.0, "presence_penalty": 0.0, '
              '"temperature": 0.0, "max_tokens": 4000, "top_p": 1.0, "stream": false, "messages": ')
_THREAD2 = _thread_json_sql([("'system'", O.lit(_COT)), ("'user'", "problem")])


@register("build_requests", _with(attempts=O.ATTEMPTS) +
          "SELECT problem_id, attempt, md5(concat_ws('|', 'reject_sample', CAST(problem_id AS VARCHAR), "
          f"CAST(attempt AS VARCHAR))) AS request_id, {O.lit(_BODY_HEAD)} || {_THREAD2} || '}}' AS body_json "
          "FROM attempts")
def q_build_requests(spark, sf_dir):
    a = R.build_threads(T.attempts(spark, sf_dir), "problem", _COT)
    r = R.build_requests(a, "reject_sample", ["problem_id", "attempt"], model="gpt-3.5-turbo", max_tokens=4000)
    return r.select("problem_id", "attempt", "request_id", "body_json")


# ---------------------------------------------------------------------------
# 2.3 Responses
# ---------------------------------------------------------------------------
_RESOLVE_SQL = _with(log=O.ATTEMPT_LOG) + """, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt_seq) AS k,
  coalesce(status = 200, false) OR (status IS NOT NULL AND status <> 200 AND coalesce(contains(body, '400'), false)) AS term FROM log),
ft AS (SELECT request_id, min(CASE WHEN term THEN k END) AS tk, count(*) AS n FROM r GROUP BY request_id)
SELECT ft.request_id,
  CASE WHEN tk <= 3 AND r.status = 200 THEN 'ok' WHEN tk <= 3 THEN 'client_error' WHEN n >= 3 THEN 'failed' ELSE 'incomplete' END AS outcome,
  CASE WHEN tk <= 3 AND r.status = 200 THEN coalesce(r.body, '') WHEN tk <= 3 THEN chr(92) || 'boxed{' || r.body || '}' END AS content,
  CAST(CASE WHEN tk <= 3 THEN tk ELSE least(n, 3) END AS BIGINT) AS attempts_used,
  CAST(CASE WHEN tk <= 3 THEN r.status END AS INT) AS final_status
FROM ft LEFT JOIN r ON r.request_id = ft.request_id AND r.k = ft.tk"""


@register("resolve_attempts", _RESOLVE_SQL)
def q_resolve(spark, sf_dir):
    return C.resolve_attempts(T.attempt_log(spark, sf_dir), max_retry=3)


@register("join_responses", _with(attempts=O.ATTEMPTS) +
          "SELECT md5(concat_ws('|', 'reject_sample', CAST(problem_id AS VARCHAR), CAST(attempt AS VARCHAR))) "
          "AS request_id, problem_id, attempt, response FROM attempts")
def q_join_responses(spark, sf_dir):
    a = T.attempts(spark, sf_dir)
    reqs = a.select("problem_id", "attempt", R.request_id("reject_sample", "problem_id", "attempt").alias("request_id"))
    resp = a.select(R.request_id("reject_sample", "problem_id", "attempt").alias("request_id"), "response")
    return C.join_responses(reqs, resp).select("request_id", "problem_id", "attempt", "response")


_LINES = ("SELECT batch_id, CAST(i - 1 AS INT) AS line_no, string_split(sc, chr(10))[i] AS line FROM "
          f"(SELECT batch_id, {O.strip('content')} AS sc FROM candidates) c, "
          "range(1, len(string_split(sc, chr(10))) + 1) r(i)")


@register("split_candidates", _with(candidates=O.CANDIDATES) + _LINES)
def q_split(spark, sf_dir):
    return C.split_candidates(T.candidates(spark, sf_dir))


# Responses as models also give them: a missing one, lines wrapped in an array,
# text after the object, and one of 120 lines.
_ODD_LINES = ['{"problem": "p", "answer": "1"}]', '{"problem": "p", "answer": "1"}] junk', '{"problem": "p", "answer": "1"}}',
              '{"problem": "p", "answer": "1"},', '[{"problem": "p", "answer": "1"}', '{"problem": "p", "answer": "1"}, 0',
              '{"problem": "p", "answer": "1"}],[0', '{"problem": "x\u00b2/2", "answer": "1"}']
_ODD_SQL = ("SELECT batch_id, CASE WHEN batch_id % 11 = 0 THEN NULL "
            "WHEN batch_id % 50 = 1 THEN (SELECT string_agg('{\"problem\": \"P' || batch_id || '-' || i || '\", \"answer\": \"' "
            "|| i || '\"}', chr(10) ORDER BY i) FROM range(120) q(i)) "
            + " ".join(f"WHEN batch_id % 13 = {i} THEN content || chr(10) || {O.lit(x)}" for i, x in enumerate(_ODD_LINES))
            + " ELSE content END AS content FROM candidates")


def _odd_candidates(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    b = F.col("batch_id")
    many = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.concat(
        F.lit('{"problem": "P'), b.cast("string"), F.lit("-"), i.cast("string"), F.lit('", "answer": "'),
        i.cast("string"), F.lit('"}'))), "\n")
    out = F.when(b % 11 == 0, F.lit(None).cast("string")).when(b % 50 == 1, many)
    for i, x in enumerate(_ODD_LINES):
        out = out.when(b % 13 == i, F.concat("content", F.lit("\n" + x)))
    return c.withColumn("content", out.otherwise(F.col("content")))


_ODD = dict(candidates=O.CANDIDATES, odd=_ODD_SQL, lines=_LINES.replace("FROM candidates", "FROM odd"))


@register("validate_candidates", _with(**_ODD) +
          f"SELECT batch_id, line_no, line FROM lines WHERE {O.json_reason('line', True, True)} IS NULL")
def q_validate(spark, sf_dir):
    v = C.validate_candidates(_odd_candidates(spark, sf_dir), add_sol=True, add_ans=True)
    return v.where("valid").select("batch_id", "line_no", "line")


@register("rejects", _with(**_ODD) +
          f"SELECT batch_id, line_no, line, {O.json_reason('line', False, True)} AS reason FROM lines "
          f"WHERE {O.json_reason('line', False, True)} IS NOT NULL")
def q_rejects(spark, sf_dir):
    v = C.validate_candidates(_odd_candidates(spark, sf_dir), add_sol=False, add_ans=True)
    return v.where(~F.col("valid")).select("batch_id", "line_no", "line", "reason")


_SINGLE_DOC = f"{O.strip('CASE WHEN batch_id % 2 = 0 THEN string_split(content, chr(10))[1] ELSE content END')}"


@register("validate_single", _with(candidates=O.CANDIDATES) +
          f"SELECT batch_id, {O.json_reason('doc', True, True)} IS NULL AS valid, {O.json_reason('doc', True, True)} "
          f"AS reason FROM (SELECT batch_id, {_SINGLE_DOC} AS doc FROM candidates)")
def q_validate_single(spark, sf_dir):
    c = T.candidates(spark, sf_dir).withColumn(
        "content", F.when(F.col("batch_id") % 2 == 0, F.split("content", "\n")[0]).otherwise(F.col("content")))
    return C.validate_single(c).select("batch_id", "valid", "reason")


@register("generation_yield", _with(**_ODD) +
          f"SELECT sum(CASE WHEN {O.json_reason('line', False, True)} IS NULL THEN 1 ELSE 0 END)::BIGINT AS valid, "
          "((SELECT count(*) FROM odd) * 5)::BIGINT AS max_valid, "
          f"round(sum(CASE WHEN {O.json_reason('line', False, True)} IS NULL THEN 1 ELSE 0 END) / "
          "((SELECT count(*) FROM odd) * 5), 4) AS yield FROM lines")
def q_yield(spark, sf_dir):
    v = C.validate_candidates(_odd_candidates(spark, sf_dir), add_sol=False, add_ans=True, outer=True)
    return C.generation_yield(v, 5, "batch_id")


# ---------------------------------------------------------------------------
# 2.6 Training rows (instruction pairs from `conversations`)
# ---------------------------------------------------------------------------
from boxwise.operators import ordinal  # noqa: E402
from boxwise.operators import packing as PK  # noqa: E402
from boxwise.operators import sft  # noqa: E402
from boxwise.operators import tokens as TK  # noqa: E402

MAXLEN = sft.DEFAULT_MAX_LEN
PAT = O.lit(TK.TOKEN_PATTERN)


def _pairs(spark, sf_dir, blank_every=None):
    sp = T.sft_pairs(spark, sf_dir, blank_every)
    return sp.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "instruction", "output")


def _vocab(spark, sf_dir):
    return cut_lineage(TK.build_vocab(_pairs(spark, sf_dir), ["instruction", "output"]), "vocab")


def _src_sql(blank_every=None):
    return (f"SELECT concat_ws('-', conv_id, turn) AS pair_id, instruction, output FROM ({O.sft_pairs(blank_every)}) s0")


_VOCAB_SQL = (
    "SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 2)::INT AS id, n FROM ("
    "SELECT token, count(*)::BIGINT AS n FROM ("
    f"SELECT unnest(regexp_extract_all(instruction, {PAT})) AS token FROM src UNION ALL "
    f"SELECT unnest(regexp_extract_all(output, {PAT})) AS token FROM src) w "
    "GROUP BY token) v")


def _rendered_sql(text_expr: str) -> str:
    return (f"SELECT pair_id, instruction, output, instruction || {NL2} || output AS prompt, "
            f"instruction || {NL2} AS pwr, {text_expr} AS txt FROM src")


def _enc_sql(limit: int | None) -> str:
    keep = "tk.pos IS NOT NULL" + (f" AND tk.pos <= {limit - 1}" if limit else "")
    return (
        "toks AS (SELECT pair_id, i AS pos, t[i] AS token FROM "
        f"(SELECT pair_id, regexp_extract_all(txt, {PAT}) AS t FROM rendered) r, range(1, len(t) + 1) q(i)),\n"
        "enc AS (SELECT r.pair_id, any_value(r.instruction) AS instruction, any_value(r.pwr) AS pwr, "
        f"list_concat([1], coalesce(list(coalesce(v.id, 0) ORDER BY tk.pos) FILTER (WHERE {keep}), [])) AS ids "
        "FROM rendered r LEFT JOIN toks tk ON tk.pair_id = r.pair_id LEFT JOIN vocab v ON v.token = tk.token "
        "GROUP BY r.pair_id)\n")


def _t_with(text_expr: str, limit: int | None, blank_every=None) -> str:
    return (f"WITH src0 AS ({_src_sql()}),\nsrc AS ({_src_sql(blank_every)}),\n"
            f"vocab AS ({_VOCAB_SQL.replace('FROM src', 'FROM src0')}),\n"
            f"rendered AS ({_rendered_sql(text_expr)}),\n" + _enc_sql(limit))


def _eos(ids: str, limit: int | None) -> str:
    cond = f"{ids}[-1] <> 2" + (f" AND len({ids}) < {limit}" if limit else "")
    return f"(CASE WHEN {cond} THEN list_append({ids}, 2) ELSE {ids} END)"


def _ones(ids: str) -> str:
    return f"list_transform({ids}, lambda x: 1)"


def _mask(ids: str, k: str) -> str:
    return f"list_concat(list_transform(range({k}), lambda x: -100), {ids}[{k} + 1:])"


_K = f"least(len(regexp_extract_all(pwr, {PAT})) + 1, {MAXLEN})"


@register("build_vocab", f"WITH src AS ({_src_sql()}) {_VOCAB_SQL}")
def q_build_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@register("encode", _t_with("prompt", MAXLEN) + "SELECT pair_id, ids AS input_ids FROM enc")
def q_encode(spark, sf_dir):
    r = P.render_template(_pairs(spark, sf_dir))
    e = TK.encode(r, "prompt", _vocab(spark, sf_dir), "pair_id", "input_ids", MAXLEN)
    return e.select("pair_id", "input_ids")


@register("labels_full", _t_with("prompt", MAXLEN) +
          f"SELECT pair_id, {_eos('ids', MAXLEN)} AS input_ids, {_ones(_eos('ids', MAXLEN))} AS attention_mask, "
          f"{_eos('ids', MAXLEN)} AS labels FROM enc")
def q_labels_full(spark, sf_dir):
    return sft.map_dataset(_pairs(spark, sf_dir), _vocab(spark, sf_dir), "pair_id", "wo_ignore", MAXLEN)


@register("labels_masked", _t_with("prompt", MAXLEN) +
          f"SELECT pair_id, x AS input_ids, {_ones('x')} AS attention_mask, {_mask('x', _K)} AS labels "
          f"FROM (SELECT *, {_eos('ids', MAXLEN)} AS x FROM enc) e")
def q_labels_masked(spark, sf_dir):
    return sft.map_dataset(_pairs(spark, sf_dir), _vocab(spark, sf_dir), "pair_id", "ignore", MAXLEN)


_MIX_SQL = (_t_with("CASE WHEN instruction = '' THEN output ELSE prompt END", MAXLEN, blank_every=5) +
            f"SELECT pair_id, x AS input_ids, {_ones('x')} AS attention_mask, "
            f"CASE WHEN instruction = '' THEN x ELSE {_mask('x', _K)} END AS labels, len(x)::INT AS length FROM ("
            f"SELECT *, {_eos('y', MAXLEN)} AS x FROM (SELECT *, CASE WHEN instruction = '' THEN ids[2:] "
            f"ELSE ids END AS y FROM enc) e1) e2")


@register("labels_mix", _MIX_SQL)
def q_labels_mix(spark, sf_dir):
    return sft.map_dataset(_pairs(spark, sf_dir, 5), _vocab(spark, sf_dir), "pair_id", "mix", MAXLEN)


@register("encode_concat", _t_with("prompt", None) + f"SELECT pair_id, {_eos('ids', None)} AS input_ids FROM enc")
def q_encode_concat(spark, sf_dir):
    return sft.encode_concat(_pairs(spark, sf_dir), _vocab(spark, sf_dir), "pair_id")


PACK_ROWS = PK.BATCH_ROWS
_PACK_SQL = (_t_with("prompt", None) + f""",
rows AS (SELECT pair_id, {_eos('ids', None)} AS x, row_number() OVER (ORDER BY pair_id) - 1 AS ord FROM enc),
rb AS (SELECT *, CAST(floor(ord / {PACK_ROWS}) AS BIGINT) AS batch_id, len(x) AS n FROM rows),
ro AS (SELECT *, sum(n) OVER (PARTITION BY batch_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS start FROM rb),
st AS (SELECT batch_id, start + i - 1 AS p, x[i] AS id FROM ro, range(1, len(x) + 1) q(i))
SELECT batch_id, CAST(floor(p / {MAXLEN}) AS BIGINT) AS block_no, list(id ORDER BY p) AS input_ids,
  list_transform(list(id ORDER BY p), lambda z: 1) AS attention_mask, list(id ORDER BY p) AS labels
FROM st GROUP BY batch_id, floor(p / {MAXLEN})""")


@register("pack_blocks", _PACK_SQL)
def q_pack_blocks(spark, sf_dir):
    e = sft.encode_concat(_pairs(spark, sf_dir), _vocab(spark, sf_dir), "pair_id")
    return PK.pack_blocks(e, "input_ids", "pair_id", MAXLEN, PACK_ROWS)


_SHUFFLED_SQL = _PACK_SQL.replace("row_number() OVER (ORDER BY pair_id)",
                                  "row_number() OVER (ORDER BY md5('7|' || pair_id), pair_id)")


@register("map_concat", _SHUFFLED_SQL)
def q_map_concat(spark, sf_dir):
    return sft.map_dataset(_pairs(spark, sf_dir), _vocab(spark, sf_dir), "pair_id", "concat", MAXLEN, shuffle=7)


@register("chunk_overflow", _t_with("prompt", None) +
          f"SELECT pair_id, c AS chunk_no, CASE WHEN c = (len(ids) - 1) // {MAXLEN} AND len(ch) < {MAXLEN} "
          f"AND ch[-1] <> 2 THEN list_append(ch, 2) ELSE ch END AS chunk FROM ("
          f"SELECT pair_id, ids, c, ids[c * {MAXLEN} + 1:(c + 1) * {MAXLEN}] AS ch FROM enc, "
          f"range(0, (len(ids) - 1) // {MAXLEN} + 1) q(c)) t")
def q_chunk_overflow(spark, sf_dir):
    r = P.render_template(_pairs(spark, sf_dir))
    e = TK.encode(r, "prompt", _vocab(spark, sf_dir), "pair_id", "ids", None)
    return PK.chunk_overflow(e, "ids", MAXLEN, keep=("pair_id",))


_ROWS_FULL = f"SELECT pair_id, {_eos('ids', MAXLEN)} AS x FROM enc"


@register("pad_batches", _t_with("prompt", MAXLEN) + f""",
rf AS ({_ROWS_FULL}),
rb AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY pair_id) - 1) / 8) AS BIGINT) AS batch_id FROM rf),
bw AS (SELECT *, CAST(ceil(max(len(x)) OVER (PARTITION BY batch_id) / 8) * 8 AS INT) AS w FROM rb)
SELECT pair_id, batch_id,
  list_concat(list_transform(range(w - len(x)), lambda z: 0), x) AS input_ids,
  list_concat(list_transform(range(w - len(x)), lambda z: 0), list_transform(x, lambda z: 1)) AS attention_mask,
  list_concat(list_transform(range(w - len(x)), lambda z: -100), x) AS labels FROM bw""")
def q_pad_batches(spark, sf_dir):
    rows = sft.map_dataset(_pairs(spark, sf_dir), _vocab(spark, sf_dir), "pair_id", "wo_ignore", MAXLEN)
    rows = ordinal.with_ordinal(rows, ["pair_id"], "_o").withColumn(
        "batch_id", F.floor(F.col("_o") / 8).cast("bigint")).drop("_o")
    return PK.pad_batches(rows, "batch_id")


@register("length_batches", _MIX_SQL.replace(
    "SELECT pair_id, x AS input_ids", "SELECT pair_id, len(x)::INT AS length, CAST(floor((row_number() OVER "
    "(ORDER BY len(x) DESC, pair_id) - 1) / 8) AS BIGINT) AS batch_id, x AS input_ids", 1)
          .replace("SELECT pair_id, len(x)::INT AS length, CAST", "SELECT pair_id, length, batch_id FROM (SELECT pair_id, len(x)::INT AS length, CAST", 1)
          + ") lb")
def q_length_batches(spark, sf_dir):
    rows = sft.map_dataset(_pairs(spark, sf_dir, 5), _vocab(spark, sf_dir), "pair_id", "mix", MAXLEN)
    return PK.length_batches(rows, "pair_id", "length", 8).select("pair_id", "length", "batch_id")


_SPLIT_SQL = (f"SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || CAST(pair_id AS VARCHAR)), pair_id) "
              f"<= 50 THEN 'test' ELSE 'train' END AS split FROM ({_src_sql()}) s")


@register("train_test_split", _SPLIT_SQL)
def q_split(spark, sf_dir):
    return sft.train_test_split(_pairs(spark, sf_dir), 50, 42, "pair_id").select("pair_id", "split")


@register("split_counts", f"SELECT split, count(*)::BIGINT AS rows FROM ({_SPLIT_SQL}) t GROUP BY split")
def q_split_counts(spark, sf_dir):
    return sft.split_counts(sft.train_test_split(_pairs(spark, sf_dir), 50, 42, "pair_id"))


@register("subsample", f"SELECT pair_id FROM ({_src_sql()}) s ORDER BY md5('7|' || CAST(pair_id AS VARCHAR)), pair_id LIMIT 100")
def q_subsample(spark, sf_dir):
    return sft.subsample(_pairs(spark, sf_dir), 100, 7, "pair_id").select("pair_id")


@register("shuffle_rows", f"SELECT pair_id, row_number() OVER (ORDER BY md5('7|' || CAST(pair_id AS VARCHAR)), pair_id) - 1 "
          f"AS row_order FROM ({_src_sql()}) s")
def q_shuffle(spark, sf_dir):
    return sft.shuffle_rows(_pairs(spark, sf_dir), 7, "pair_id").select("pair_id", "row_order")


# ---------------------------------------------------------------------------
# 2.5 Augmentation jobs (replayed generations, synthetic solver)
# ---------------------------------------------------------------------------
from boxwise.operators import providers as PV  # noqa: E402
from boxwise.plans import augment as AG  # noqa: E402

GEN_MODEL = "gpt-4-1106-preview"


def _generation_log(spark, sf_dir, replay=T.candidates):
    """Recorded attempts of the generation requests: every seventh request always
    fails, every fifth one is answered at the second attempt."""
    def log(reqs):
        c = replay(spark, sf_dir).select(F.col("batch_id").alias("first_id"), "content")
        # a merge join: by the size of its compressed file, the table may be broadcast although the driver can't hold it
        a = reqs.select("first_id", "request_id").join(c.hint("merge"), "first_id").select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt_seq"))
        fails = (F.col("first_id") % 7 == 0) | ((F.col("first_id") % 5 == 0) & (F.col("attempt_seq") == 0))
        return a.select("request_id", "attempt_seq", F.when(fails, 500).otherwise(200).alias("status"),
                        F.when(fails, F.lit("server error")).otherwise(F.col("content")).alias("body"))
    return log


def _composer():
    return PV.synthetic(lambda: PV.compose_one_step("problem", "answer"))


def _solver(problems):
    return T.synthetic_attempts(problems)


_PARTS = [("problem", "problem"), ("solution", "solution"), ("answer", "answer"), ("subject", "subject")]


def _gen_sql(add_sol: bool, lines: str = "lines") -> str:
    return (f"SELECT batch_id AS parent_id, line_no, line, batch_id * {AG.MAX_LINES} + line_no AS problem_id, "
            "json_extract_string(line, '$.problem') AS problem, json_extract_string(line, '$.solution') AS solution, "
            f"json_extract_string(line, '$.answer') AS answer FROM {lines} WHERE {O.json_reason('line', add_sol, True)} IS NULL")


def _bootstrap_ctes(p: str, name: str, n: int, add_sol: bool) -> dict[str, str]:
    """The lines of requests answered within three attempts, solved and verified."""
    return {f"{p}p": _gen_sql(add_sol) + " AND batch_id % 7 <> 0", **O.scored_ctes(p, f"SELECT * FROM {p}p")}


def _bootstrap_sql(p: str, subset: str, prompt: str, n: int, add_sol: bool) -> str:
    head = _BODY_HEAD.replace("gpt-3.5-turbo", GEN_MODEL)
    seed = O.json_object([x for x in _PARTS if add_sol or x[0] != "solution"])
    body = (f"{O.lit(head)} || " + _thread_json_sql([("'system'", O.lit(P.system_prompt(prompt, 1, n))), ("'user'", seed)])
            + " || '}'")
    return (f"SELECT k.*, g.parent_id, g.line, b.body_json FROM ({O.kept_sql(p, subset, MODEL)}) k "
            f"JOIN {p}p g ON g.problem_id = k.problem_id JOIN (SELECT problem_id AS seed_id, {body} AS body_json FROM seeds) b "
            "ON b.seed_id = g.parent_id")


@register("question_bootstrapping", _with(candidates=O.CANDIDATES, lines=_LINES, seeds=O.SEEDS,
                                          **_bootstrap_ctes("qb", "qb", 5, False)) +
          _bootstrap_sql("qb", "question_bootstrapping", "qb", 5, False))
def q_qb(spark, sf_dir):
    return AG.question_bootstrapping(T.seeds(spark, sf_dir), _generation_log(spark, sf_dir), _solver, model=MODEL, max_retry=3)


@register("similar_problems", _with(candidates=O.CANDIDATES, lines=_LINES, seeds=O.SEEDS,
                                    **_bootstrap_ctes("sim", "similar", 3, True)) +
          _bootstrap_sql("sim", "similar_problems", "similar", 3, True))
def q_similar(spark, sf_dir):
    return AG.similar_problems(T.seeds(spark, sf_dir), _generation_log(spark, sf_dir), _solver, model=MODEL, max_retry=3)


@register("generated_problems", _with(**_ODD) + _gen_sql(False))
def q_generated(spark, sf_dir):
    """C3-C4 on awkward responses, some of 120 lines: every line has its own id."""
    return AG.generated_problems(_odd_candidates(spark, sf_dir).withColumnRenamed("batch_id", "first_id"), False, True)


def _compose_sql(src: str, it: int) -> str:
    nxt = "CAST(TRY_CAST(answer AS BIGINT) + 1 AS VARCHAR)"
    prob = "problem || ' Then add 1 to the result.'"
    sol = f"'Add one: $' || chr(92) || 'boxed{{' || {nxt} || '}}$.'"
    doc = O.json_object([("problem", prob), ("solution", sol), ("answer", nxt)])
    return (f"SELECT {it} AS iteration, problem_id, problem_id AS parent_id, {prob} AS problem, {sol} AS solution, "
            f"{nxt} AS answer, {doc} AS line FROM {src} WHERE TRY_CAST(answer AS BIGINT) IS NOT NULL")


_COMPOSE_CTES = dict(seeds=O.SEEDS, comp0=_compose_sql("seeds", 0), comp1=_compose_sql("comp0", 1))


@register("compose_iterations", _with(**_COMPOSE_CTES) + "SELECT * FROM comp0 UNION ALL SELECT * FROM comp1")
def q_compose(spark, sf_dir):
    rounds = AG.compose_iterations(T.seeds(spark, sf_dir), _composer(), rounds=2)
    return rounds[0].unionByName(rounds[1])


@register("answer_augmentation", _with(**O.scored_ctes("aa", O.SEEDS)) +
          O.kept_sql("aa", "answer_augmentation", MODEL))
def q_answer_aug(spark, sf_dir):
    return AG.answer_augmentation(T.seeds(spark, sf_dir), _solver, MODEL)


_CORPUS_CTES = dict(
    candidates=O.CANDIDATES, lines=_LINES, seeds=O.SEEDS,
    comp0=_compose_sql("seeds", 0), comp1=_compose_sql("comp0", 1),
    **O.scored_ctes("aa", "SELECT * FROM seeds"), **_bootstrap_ctes("qb", "qb", 5, False),
    **_bootstrap_ctes("sim", "similar", 3, True), **O.scored_ctes("i0", "SELECT * FROM comp0"),
    **O.scored_ctes("i1", "SELECT * FROM comp1"))
_CORPUS_SQL = " UNION ALL ".join([
    O.kept_sql("aa", "answer_augmentation", MODEL), O.kept_sql("qb", "question_bootstrapping", MODEL),
    O.kept_sql("sim", "similar_problems", MODEL), O.kept_sql("i0", "compose_iter0", MODEL),
    O.kept_sql("i1", "compose_iter1", MODEL)])


def _corpus(spark, sf_dir):
    seeds = T.seeds(spark, sf_dir)
    log = _generation_log(spark, sf_dir)
    rounds = AG.compose_iterations(seeds, _composer(), rounds=2)
    parts = [
        AG.answer_augmentation(seeds, _solver, MODEL),
        AG.question_bootstrapping(seeds, log, _solver, model=MODEL, max_retry=3),
        AG.similar_problems(seeds, log, _solver, model=MODEL, max_retry=3),
        AG.verified_solutions(rounds[0], _solver, MODEL, "compose_iter0"),
        AG.verified_solutions(rounds[1], _solver, MODEL, "compose_iter1"),
    ]
    return AG.assemble_corpus(parts)


@register("assemble_corpus", _with(**_CORPUS_CTES) + _CORPUS_SQL)
def q_corpus(spark, sf_dir):
    return _corpus(spark, sf_dir)


@register("to_instruction_pairs", _with(**_CORPUS_CTES) +
          f"SELECT subset, problem_id, {O.lit(texts.INSTRUCTION_PROMPT.split('{question}')[0])} || problem || {NL2} "
          f"AS instruction, solution AS output FROM ({_CORPUS_SQL}) c")
def q_pairs(spark, sf_dir):
    return AG.to_instruction_pairs(_corpus(spark, sf_dir))


@register("exam_answers", "SELECT item_id, text AS question, 'Answer: ' || CAST(length(text) AS VARCHAR) AS answer "
          "FROM benchmark")
def q_exam_answers(spark, sf_dir):
    from boxwise.operators import evaluate as EV
    b = T.load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    provider = PV.synthetic(lambda: F.concat(F.lit("Answer: "), F.length("question").cast("string")), "answer")
    return EV.exam_answers(b, provider, "few_shot").select("item_id", "question", "answer")


# ---------------------------------------------------------------------------
# 2.1 Sources and sinks (round trips through the checkpoint folder)
# ---------------------------------------------------------------------------
from boxwise.sources import exam as EX  # noqa: E402
from boxwise.sources import jsonl as JL  # noqa: E402
from boxwise.sources import splits as SP  # noqa: E402

SEED_SCHEMA = "problem_id BIGINT, problem STRING, solution STRING, answer STRING"


@register("scan_jsonl", _with(seeds=O.SEEDS) +
          "SELECT problem_id, problem, answer FROM (SELECT *, row_number() OVER (ORDER BY problem_id) - 1 AS k, "
          "count(*) OVER () AS n FROM seeds) t WHERE k >= 100 AND k < n - 100")
def q_scan_jsonl(spark, sf_dir):
    """Seeds written as JSON lines (some followed by a blank line), read back
    with blank lines skipped and the Python slice [100:-100] applied."""
    path = scratch_path(spark, "seeds-jsonl")
    s = T.seeds(spark, sf_dir)
    line = F.to_json(F.struct("problem_id", "problem", "solution", "answer"))
    line = F.when(F.col("problem_id") % 7 == 0, F.concat(line, F.lit("\n  "))).otherwise(line)
    JL.write_text_lines(s.orderBy("problem_id").select(line.alias("l")), "l", path)
    out = JL.read_jsonl(spark, path, SEED_SCHEMA, start=100, end=-100)
    return out.select("problem_id", "problem", "answer")


_EXAM_Q = "CASE WHEN item_id % 2 = 0 THEN text || chr(10) || 'Explain \"why\", briefly.' ELSE text END"


@register("scan_exam_csv", f"SELECT {_EXAM_Q} AS question FROM benchmark")
def q_scan_exam(spark, sf_dir):
    path = scratch_path(spark, "exam-csv")
    b = T.load(spark, sf_dir, "benchmark")
    q = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit('\nExplain "why", briefly.'))).otherwise(F.col("text"))
    EX.write_exam_csv(b.select(q.alias("question")), path)
    return EX.read_exam_csv(spark, path)


@register("load_splits", _SPLIT_SQL)
def q_load_splits(spark, sf_dir):
    root = scratch_path(spark, "splits")
    SP.write_splits(sft.train_test_split(_pairs(spark, sf_dir), 50, 42, "pair_id"), root)
    parts = SP.load_splits(spark, root)
    return parts["train"].select("pair_id", F.lit("train").alias("split")).unionByName(
        parts["test"].select("pair_id", F.lit("test").alias("split")))


_KEPT = _with(**_SCORED_CTES) + (f"SELECT problem, response AS solution, answer, '{MODEL}' AS source "
                                 "FROM scored WHERE attempt < 3 AND correct")


@register("append_jsonl", _KEPT + " UNION ALL " + _KEPT.split("\n")[-1])
def q_append(spark, sf_dir):
    """Verified solutions appended twice to one JSONL folder (a rerun adds rows)."""
    path = scratch_path(spark, "rej-sample-jsonl")
    kept = sampling.reject_sample(scored_attempts(spark, sf_dir), 3, 3).select(
        "problem", F.col("response").alias("solution"), "answer", F.lit(MODEL).alias("source"))
    kept = cut_lineage(kept)
    JL.append_jsonl(kept, path)
    JL.append_jsonl(kept, path)
    return spark.read.schema("problem STRING, solution STRING, answer STRING, source STRING").json(path)


@register("export_exam", "SELECT 'Answer: ' || CAST(length(text) AS VARCHAR) AS answer, text AS question FROM benchmark")
def q_export_exam(spark, sf_dir):
    csv_path, json_path = scratch_path(spark, "exam-out-csv"), scratch_path(spark, "exam-out-jsonl")
    b = T.load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    provider = PV.synthetic(lambda: F.concat(F.lit("Answer: "), F.length("question").cast("string")), "answer")
    from boxwise.operators import evaluate as EV
    EX.export_exam(EV.exam_answers(b, provider), csv_path, json_path)
    return spark.read.schema("answer STRING, question STRING").json(json_path)


# ---------------------------------------------------------------------------
# 2.7 Streaming and SQL functions
# ---------------------------------------------------------------------------
from boxwise.functions.registry import register_sql_functions  # noqa: E402
from boxwise.streaming import line_sinks as LS  # noqa: E402
from boxwise.streaming import reply_stream as RS  # noqa: E402
from boxwise.streaming import verify_stream as WS  # noqa: E402


@register("stream_verify", _with(**_SCORED_CTES) + "SELECT problem_id, attempt, model_answer, correct FROM scored")
def q_stream_verify(spark, sf_dir):
    """Attempts land as two JSON drops; the stream verifies both, appending."""
    src, sink, ck = (scratch_path(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    a = T.attempts(spark, sf_dir)
    a.where(F.col("attempt") < 2).write.mode("append").json(src)
    a.where(F.col("attempt") >= 2).write.mode("append").json(src)
    schema = "problem_id BIGINT, problem STRING, answer STRING, attempt INT, response STRING"
    WS.run_verify_stream(spark, src, sink, ck, schema, keep=("problem_id", "attempt"))
    return spark.read.parquet(sink)


@register("stream_yield", _with(**_ODD) +
          f"SELECT 'question_bootstrapping' AS task, sum(CASE WHEN {O.json_reason('line', False, True)} IS NULL "
          "THEN 1 ELSE 0 END)::BIGINT AS valid, count(*)::BIGINT AS lines, (SELECT count(*) * 5 FROM odd)::BIGINT AS max_valid FROM lines")
def q_stream_yield(spark, sf_dir):
    src, ck = scratch_path(spark, "yield-src"), scratch_path(spark, "yield-ckpt")
    c = _odd_candidates(spark, sf_dir).select(F.lit("question_bootstrapping").alias("task"), "batch_id", "content")
    c.where(F.col("batch_id") % 2 == 0).write.mode("append").json(src)
    c.where(F.col("batch_id") % 2 == 1).write.mode("append").json(src)
    name = "yield_" + src.rsplit("-", 1)[-1]
    return WS.run_yield_stream(spark, src, ck, name)


_REPLY_LIMIT = "6 hours"


@register("stream_join_responses", _with(log=O.ATTEMPT_LOG) + """
, q AS (SELECT request_id, min(attempt_ts) AS requested_at FROM log GROUP BY request_id)
SELECT q.request_id, l.attempt_seq, l.body FROM q LEFT JOIN log l ON l.request_id = q.request_id AND l.status = 200
  AND l.attempt_ts >= q.requested_at AND l.attempt_ts <= q.requested_at + INTERVAL 6 HOURS""")
def q_stream_join(spark, sf_dir):
    """Requests and replies land as two drops each; a last pair of rows far ahead
    moves the watermark over all that still wait."""
    log = T.attempt_log(spark, sf_dir).withColumn("attempt_ts", F.col("attempt_ts").cast("timestamp"))
    asked = log.groupBy("request_id").agg(F.min("attempt_ts").alias("requested_at"))
    replies = log.where("status = 200").select("request_id", "attempt_seq", "body", F.col("attempt_ts").alias("answered_at"))
    src, sink, ck = (scratch_path(spark, n) for n in ("reply-src", "reply-sink", "reply-ckpt"))
    for drop in (0, 1, 2):
        for rows, name, at in ((asked, "asked", "requested_at"), (replies, "replies", "answered_at")):
            if drop < 2:
                part = rows.where(F.pmod(F.xxhash64("request_id"), F.lit(2)) == drop)
            else:
                part = spark.range(1).select(F.timestamp_seconds(F.lit(4102444800)).alias(at))
                # with a key, as rows without one don't reach the watermark of the replies
                part = part.select(*[F.col(c) if c == at else F.lit("" if c == "request_id" else None).cast(
                    rows.schema[c].dataType).alias(c) for c in rows.columns])
            part.write.mode("append").parquet(f"{src}/{name}")
        RS.run_reply_stream(spark, f"{src}/asked", f"{src}/replies", sink, ck, asked.schema, replies.schema,
                            _REPLY_LIMIT, "3650 days")
    return spark.read.parquet(sink).where("request_id <> ''").select("request_id", "attempt_seq", "body")


@register("stream_rejects", _with(**_ODD) +
          f"SELECT batch_id, line_no, line, {O.json_reason('line', False, True)} AS reason FROM lines "
          f"WHERE {O.json_reason('line', False, True)} IS NOT NULL")
def q_stream_rejects(spark, sf_dir):
    """The rejects sink of a stream of responses in two drops."""
    src, root, ck = (scratch_path(spark, n) for n in ("sinks-src", "sinks", "sinks-ckpt"))
    c = _odd_candidates(spark, sf_dir).select(F.lit("question_bootstrapping").alias("task"), "batch_id", "content")
    for odd in (0, 1):
        c.where(F.col("batch_id") % 2 == odd).write.mode("append").json(src)
        LS.run_line_sinks(spark, src, root, ck)
    return LS.read_sink(spark, root, "rejects").select("batch_id", "line_no", "line", "reason")


@register("sql_functions", _with(**_SCORED_CTES) + "SELECT problem_id, attempt, model_answer, correct FROM scored")
def q_sql_functions(spark, sf_dir):
    register_sql_functions(spark)
    T.attempts(spark, sf_dir).createOrReplaceTempView("bw_attempts")
    return spark.sql("SELECT problem_id, attempt, model_answer, bw_answers_match(answer, model_answer) AS correct "
                     "FROM (SELECT *, bw_extract_answer(response) AS model_answer FROM bw_attempts)")


@register("extract_answer_documents",
          f"SELECT doc_id, {O.extraction_method('text')} AS method, {O.extract_answer('text')} AS model_answer "
          "FROM documents")
def q_extract_documents(spark, sf_dir):
    """A3/A4 over whole long texts (the `documents` table, up to 20,000 words)."""
    d = T.load(spark, sf_dir, "documents").select("doc_id", "text")
    d = verify.extract_answers(d, "text", "model_answer", "method")
    return d.select("doc_id", "method", "model_answer")
