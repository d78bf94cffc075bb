"""The data-augmentation jobs, composed from the operators.

* answer augmentation (V6): rejection-sample solutions to the seeds;
* question bootstrapping (V7) and similar problems (V8): batch the seeds,
  build requests, get responses, keep the valid generated lines, then
  rejection-sample the new problems;
* iterative composition (V9): one new problem per problem of the previous
  round (the *unverified* output of round k-1 feeds round k); each round is
  written to the shared folder so lineage does not grow with rounds;
* corpus (V10) and instruction pairs (V11).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.operators import prompts, providers, requests, responses, sampling, verify
from boxwise.session import cut_lineage

Solver = Callable[[DataFrame], DataFrame]
CORPUS_COLUMNS = ["subset", "problem_id", "problem", "solution", "answer", "source"]


def verified_solutions(problems: DataFrame, solver: Solver, model: str, subset: str,
                       num_sample_1q: int = 3, max_valid_1q: int = 3) -> DataFrame:
    """V1 over a problem table: attempts from ``solver`` (problem_id, attempt,
    response), answers checked against ``answer``, caps applied. The solver is
    called once."""
    att = solver(problems)
    att = verify.extract_answers(att, "response", "model_answer")
    att = verify.verify_answers(att, "answer", "model_answer", "correct")
    kept = sampling.reject_sample(att, num_sample_1q, max_valid_1q)
    return kept.select(F.lit(subset).alias("subset"), "problem_id", "problem",
                       F.col("response").alias("solution"), "answer", F.lit(model).alias("source"))


def answer_augmentation(seeds: DataFrame, solver: Solver, model: str = "gpt-3.5-turbo",
                        num_sample_1q: int = 3, max_valid_1q: int = 3) -> DataFrame:
    """V6: verified solutions to the seed problems, tagged with the model."""
    return verified_solutions(seeds, solver, model, "answer_augmentation", num_sample_1q, max_valid_1q)


def generation_requests(seeds: DataFrame, prompt_name: str, num_example: int, num_generate: int,
                        add_sol: bool, add_ans: bool, task: str, model: str = "gpt-4-1106-preview",
                        max_tokens: int = 4000, temperature: float = 0.0, raw_col: str | None = None) -> DataFrame:
    """P4-P6, P8, P11 for batch generation: (batch_id, first_id, user_prompt,
    messages, request_id, params, body_json)."""
    b = prompts.batch_seeds(seeds, num_example, add_sol, add_ans, raw_col=raw_col)
    return _with_bodies(b, prompt_name, num_example, num_generate, task, model, max_tokens, temperature)


def _with_bodies(batches: DataFrame, prompt_name: str, num_example: int, num_generate: int, task: str,
                 model: str = "gpt-4-1106-preview", max_tokens: int = 4000, temperature: float = 0.0) -> DataFrame:
    """P8 and P11 on rows with a ``batch_id`` and its ``user_prompt``."""
    sysp = prompts.system_prompt(prompt_name, num_example, num_generate)
    t = requests.build_threads(batches, "user_prompt", sysp)
    return requests.build_requests(t, task, ["batch_id"], model=model, max_tokens=max_tokens,
                                   temperature=temperature)


MAX_LINES = 1 << 20  # lines of one response that ids have room for


def line_id(parent: str, line_no: str = "line_no") -> Column:
    """The id of a generated line: its own for every (parent, line). A response
    with more lines than there is room for fails the job."""
    room = F.when(F.col(line_no) < MAX_LINES, F.col(line_no)).otherwise(
        F.raise_error(F.lit(f"a response has more than {MAX_LINES} lines")).cast("int"))
    return (F.col(parent) * MAX_LINES + room).cast("bigint")


def generated_problems(resp: DataFrame, add_sol: bool, add_ans: bool, key: str = "first_id",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """C3-C4 on responses (``key``, ``content``): one row per valid generated line
    with its parent id, raw line and typed fields."""
    lines = responses.validate_candidates(resp.select(key, *keep, "content"), add_sol, add_ans, "content").where("valid")
    lines = responses.problem_fields(lines, "line")
    return lines.select(F.col(key).alias("parent_id"), "line_no", "line", line_id(key).alias("problem_id"),
                        F.col("gen_problem").alias("problem"), F.col("gen_solution").alias("solution"),
                        F.col("gen_answer").alias("answer"), *keep)


def _bootstrapped(seeds: DataFrame, prompt_name: str, subset: str, log: Callable[[DataFrame], DataFrame],
                  solver: Solver, num_example: int, num_generate: int, add_sol: bool, model: str,
                  max_retry: int, raw_col: str | None) -> DataFrame:
    reqs = generation_requests(seeds, prompt_name, num_example, num_generate, add_sol, True, subset, raw_col=raw_col)
    outcomes = responses.resolve_attempts(cut_lineage(log(reqs), "attempt-log"), max_retry).select("request_id", "content")
    # The rows carry the user prompt through the joins; bodies, which hold the whole system prompt too, are built after them.
    # merge joins: by the size of its compressed files, a table may be broadcast that the driver can't hold
    resp = responses.join_responses(reqs.select("first_id", "request_id", "batch_id", "user_prompt"), outcomes.hint("merge"), how="inner")
    gen = cut_lineage(generated_problems(resp, add_sol, True, keep=("batch_id", "user_prompt")), "generated")
    solved = verified_solutions(gen, solver, model, subset)
    rows = solved.join(gen.select("problem_id", "parent_id", "line", "batch_id", "user_prompt").hint("merge"), "problem_id")
    return _with_bodies(rows, prompt_name, num_example, num_generate, subset).select(
        "problem_id", *[c for c in CORPUS_COLUMNS if c != "problem_id"], "parent_id", "line", "body_json")


def question_bootstrapping(seeds: DataFrame, log: Callable[[DataFrame], DataFrame], solver: Solver,
                           num_example: int = 1, num_generate: int = 5, model: str = "gpt-3.5-turbo",
                           max_retry: int = 30, raw_col: str | None = None) -> DataFrame:
    """V7: verified solutions of new problems made from ``num_example`` examples
    whose solutions are not shown (P4-P6, P8, P11, C1-C4, V1).

    ``log`` maps request rows to their attempt log (request_id, attempt_seq,
    status, body); each result carries its parent, generated line and request
    body."""
    return _bootstrapped(seeds, "qb", "question_bootstrapping", log, solver, num_example, num_generate, False, model,
                         max_retry, raw_col)


def similar_problems(seeds: DataFrame, log: Callable[[DataFrame], DataFrame], solver: Solver, num_example: int = 1,
                     num_generate: int = 3, model: str = "gpt-3.5-turbo", max_retry: int = 30,
                     raw_col: str | None = None) -> DataFrame:
    """V8: the same from examples with their solutions shown."""
    return _bootstrapped(seeds, "similar", "similar_problems", log, solver, num_example, num_generate, True, model,
                         max_retry, raw_col)


def compose_round(problems: DataFrame, provider: providers.Provider, iteration: int,
                  add_sol: bool = True, add_ans: bool = True, model: str = "gpt-4-1106-preview") -> DataFrame:
    """One round of V9 (1:1 generation, whole response = one JSON document)."""
    name = "compose_init" if iteration == 0 else "compose_iter"
    if "line" in problems.columns:  # a generated problem goes back with all its keys
        s = problems.withColumn("user_prompt", prompts.raw_seed_json("line", add_sol, add_ans))
    else:
        s = prompts.seed_json(problems, add_sol, add_ans, out="user_prompt")
    t = requests.build_threads(s, "user_prompt", prompts.system_prompt(name))
    r = requests.build_requests(t, f"compose_{iteration}", ["problem_id"], model=model, max_tokens=4000)
    out = provider(r.select("problem_id", "problem", "solution", "answer", "request_id"))
    v = responses.validate_single(out, add_sol, add_ans, "content").where("valid")
    v = responses.problem_fields(v, "doc")
    return v.select(F.lit(iteration).alias("iteration"), "problem_id", F.col("problem_id").alias("parent_id"),
                    F.col("gen_problem").alias("problem"), F.col("gen_solution").alias("solution"),
                    F.col("gen_answer").alias("answer"), F.col("doc").alias("line"))


def compose_iterations(seeds: DataFrame, provider: providers.Provider, rounds: int = 2) -> list[DataFrame]:
    """V9: a driver loop over rounds; each round's output is written once."""
    out, cur = [], seeds
    for k in range(rounds):
        gen = cut_lineage(compose_round(cur, provider, k), f"compose{k}")
        out.append(gen)
        cur = gen.select("problem_id", "problem", "solution", "answer", "line")
    return out


def assemble_corpus(parts: list[DataFrame]) -> DataFrame:
    """Union of the verified subsets (columns aligned by name). Each part is
    written to the shared folder by a job of its own, as one plan of all their
    answer checks takes more of the driver's memory with every part."""
    written = [cut_lineage(p.select(*CORPUS_COLUMNS), "corpus") for p in parts]
    corpus = written[0]
    for p in written[1:]:
        corpus = corpus.unionByName(p, allowMissingColumns=True)
    return corpus


def to_instruction_pairs(corpus: DataFrame) -> DataFrame:
    """Training pairs: instruction = scoring prompt of the problem,
    output = the verified solution."""
    return corpus.select("subset", "problem_id", prompts.instruction_prompt("problem").alias("instruction"),
                         F.col("solution").alias("output"))
