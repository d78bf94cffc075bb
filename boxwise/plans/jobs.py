"""The reference's named jobs as file-to-file Spark jobs.

``run_job(spark, task, **kwargs)`` dispatches by name, as the reference's
entry points do. Each job reads its inputs with the sources, builds request
rows, asks a provider for model text (recorded responses or any function
``requests_df -> requests_df + content``), and writes JSON lines with the
sinks. Request ids are deterministic (``md5(task|keys)``), so responses
recorded once can be replayed by id.

A provider is called once per request: its output is written to the shared
folder first, and everything a job writes, counts or returns is derived from
that one copy. ``provider`` may be the name of a registered one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.operators import (evaluate, ordinal, prompts, providers, requests, responses, sampling, sft, tokens,
                               verify)
from boxwise.resources import texts
from boxwise.session import cut_lineage
from boxwise.sources import exam, jsonl, splits

SEED_SCHEMA = "problem STRING, solution STRING, answer STRING"


def _answered(requests_df: DataFrame, provider: str | providers.Provider, out: str = "content") -> DataFrame:
    answered = providers.get_provider(provider)(requests_df).withColumnRenamed("content", out)
    return cut_lineage(answered, "provider")


def _out(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.jsonl"


def _read_seeds(spark: SparkSession, path: str, start: int, end: int | None, skip_blank: bool) -> DataFrame:
    s = jsonl.read_jsonl(spark, path, SEED_SCHEMA, start, end, skip_blank=skip_blank, keep_raw=True, strict=True)
    return s.withColumnRenamed("line_no", "problem_id")


def reject_sample(spark: SparkSession, question_fp: str, provider: str | providers.Provider,
                  model: str = "gpt-3.5-turbo", output_root: str = "output", output_name: str = "rej_sample",
                  temperature: float = 0.0, sys_prompt: str = "cot", max_tokens: int = 4000, start: int = 0,
                  end: int | None = None, num_sample_1q: int = 3, max_valid_1q: int = 3) -> DataFrame:
    """Sample solutions and keep the verified ones (V1 + V6); appends rows
    ``problem, solution, answer, source`` and returns them."""
    seeds = _read_seeds(spark, question_fp, start, end, skip_blank=True)
    att = seeds.select("problem_id", "problem", "answer",
                       F.explode(F.sequence(F.lit(0), F.lit(num_sample_1q - 1))).alias("attempt"))
    t = requests.build_threads(att, "problem", prompts.system_prompt(sys_prompt))
    r = requests.build_requests(t, "reject_sample", ["problem_id", "attempt"], model=model,
                                max_tokens=max_tokens, temperature=temperature)
    out = _answered(r, provider, "response")
    out = verify.verify_answers(verify.extract_answers(out, "response", "model_answer"))
    kept = sampling.reject_sample(out, num_sample_1q, max_valid_1q)
    rows = kept.select("problem", F.col("response").alias("solution"), "answer", F.lit(model).alias("source"))
    jsonl.append_jsonl(rows, _out(output_root, output_name))
    return rows


def generate_problem(spark: SparkSession, example_fp: str, provider: str | providers.Provider,
                     model: str = "gpt-4-1106-preview", output_root: str = "output", output_name: str = "genq",
                     num_example: int = 1, num_generate: int = 5, temperature: float = 0.0,
                     sys_prompt: str = "qb", max_tokens: int = 4000, start: int = 0, end: int | None = None,
                     add_sol: bool = False, add_ans: bool = True) -> DataFrame:
    """Batch generation (P4-P6, C3-C4); appends the valid raw lines and
    returns the validated lines with the batch's first seed id."""
    seeds = _read_seeds(spark, example_fp, start, end, skip_blank=False)
    b = prompts.batch_seeds(seeds, num_example, add_sol, add_ans, raw_col="value")
    t = requests.build_threads(b, "user_prompt", prompts.system_prompt(sys_prompt, num_example, num_generate))
    r = requests.build_requests(t, "generate_problem", ["batch_id"], model=model, max_tokens=max_tokens,
                                temperature=temperature)
    lines = responses.validate_candidates(_answered(r, provider), add_sol, add_ans, "content")
    valid = lines.where("valid")
    jsonl.write_text_lines(valid, "line", _out(output_root, output_name), mode="append")
    return lines


def genq_1q1a(spark: SparkSession, example_fp: str, provider: str | providers.Provider,
              output_name: str = "composed", model: str = "gpt-4-1106-preview", temperature: float = 0.0,
              max_tokens: int = 4000, output_root: str = "output", sys_prompt: str = "compose_init",
              start: int = 0, end: int | None = None, add_sol: bool = True, add_ans: bool = True) -> DataFrame:
    """One new problem per example (C5); appends valid documents."""
    seeds = _read_seeds(spark, example_fp, start, end, skip_blank=False)
    s = seeds.withColumn("user_prompt", prompts.raw_seed_json("value", add_sol, add_ans))
    t = requests.build_threads(s, "user_prompt", prompts.system_prompt(sys_prompt))
    r = requests.build_requests(t, "genq_1q1a", ["problem_id"], model=model, max_tokens=max_tokens,
                                temperature=temperature)
    docs = responses.validate_single(_answered(r, provider), add_sol, add_ans, "content")
    compact = F.to_json(F.parse_json(F.col("doc")))  # one line per row in the output file
    jsonl.write_text_lines(docs.where("valid").select(compact.alias("l")), "l", _out(output_root, output_name),
                           mode="append")
    return docs


def eval_math(spark: SparkSession, test_file: str, provider: str | providers.Provider,
              output_root: str = "output", output_name: str = "default") -> DataFrame:
    """Score outputs on a test file (P1, V3, V4); appends evaluation rows and
    returns the accuracy row."""
    items = _read_seeds(spark, test_file, 0, None, skip_blank=False)
    r = items.withColumn("prompt", prompts.instruction_prompt("problem"))
    out = _answered(r, provider, "model_solution")
    rows = evaluate.eval_rows(out)
    jsonl.append_jsonl(rows, _out(output_root, output_name))
    return evaluate.accuracy(rows)


def run_exam(spark: SparkSession, exam_path: str, provider: str | providers.Provider, output_name: str,
             output_root: str = "output", prompt_type: str = "few_shot") -> DataFrame:
    """Exam answers (S2, P2, V5, S5): CSV and JSON lines, overwritten."""
    q = exam.read_exam_csv(spark, exam_path)
    answered = evaluate.exam_answers(q, lambda d: _answered(d, provider, "answer"), prompt_type)
    base = f"{output_root.rstrip('/')}/{output_name}"
    exam.export_exam(answered, base + ".csv", base + ".jsonl")
    return answered


def prepare_rows(spark: SparkSession, dataset: str, output_root: str, train_mode: str = "mix",
                 max_len: int = sft.DEFAULT_MAX_LEN, n_test: int = 0, max_train: int | None = None, seed: int = 42,
                 key: str = "row_id", fmt: str = "parquet", template: str | None = None,
                 vocab_size: int | None = None) -> DataFrame:
    """Training rows (S3, T1, T2, T4, T13, T16): load the splits, split off
    ``n_test`` rows where the dataset has no test split, subsample, encode and
    label both splits in one mode, write them below ``output_root``, and return
    the rows per split. Rows without a ``key`` column get one from their order."""
    parts = splits.load_splits(spark, dataset, fmt)
    if key not in parts["train"].columns:
        parts = {k: ordinal.with_ordinal(v, ["instruction", "output"], key) for k, v in parts.items()}
    train, test = parts["train"], parts.get("test")
    if test is None and n_test > 0:
        both = sft.train_test_split(train, n_test, seed, key)
        train, test = (both.where(F.col("split") == name).drop("split") for name in ("train", "test"))
    if max_train is not None:
        train = sft.subsample(train, max_train, seed, key)
    vocab = cut_lineage(tokens.build_vocab(train, ["instruction", "output"], vocab_size), "vocab")
    counts = []
    for name, rows in (("train", train), ("test", test)):
        if rows is None:
            continue
        mapped = sft.map_dataset(rows, vocab, key, train_mode, max_len, texts.load_template(template), shuffle=seed)
        path = f"{output_root.rstrip('/')}/{name}"
        mapped.write.mode("overwrite").parquet(path)
        counts.append(spark.read.parquet(path).select(F.lit(name).alias("split")))
    return sft.split_counts(counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1]))


JOBS: dict[str, Callable[..., DataFrame]] = {
    "reject_sample": reject_sample,
    "generate_problem": generate_problem,
    "genq_1q1a": genq_1q1a,
    "eval_MATH": eval_math,
    "run_exam": run_exam,
    "prepare_rows": prepare_rows,
}


def run_job(spark: SparkSession, task: str, **kwargs) -> DataFrame:
    if task not in JOBS:
        raise KeyError(f"unknown task {task!r}; choose from {sorted(JOBS)}")
    return JOBS[task](spark, **kwargs)
