"""The named file-to-file jobs with deterministic providers."""
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from boxwise.operators import providers
from boxwise.plans.jobs import run_job
from boxwise.sources import tables as T
from conftest import SF001


def _seed_file(spark, n=30):
    d = tempfile.mkdtemp(prefix="bw-jobs-")
    rows = T.seeds(spark, SF001).orderBy("problem_id").limit(n).collect()
    path = os.path.join(d, "seeds.jsonl")
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps({"problem": r.problem, "solution": r.solution, "answer": r.answer}) + "\n")
    return d, path, rows


def test_reject_sample_job(spark):
    d, path, rows = _seed_file(spark)
    prov = providers.synthetic(lambda: F.when(F.col("attempt") % 2 == 0,
                                              F.concat(F.lit("so \\boxed{"), F.col("answer"), F.lit("}")))
                               .otherwise(F.lit("no idea")))
    out = run_job(spark, "reject_sample", question_fp=path, provider=prov, output_root=d, output_name="rs")
    assert out.count() == 2 * len(rows)
    written = spark.read.json(os.path.join(d, "rs.jsonl"))
    assert sorted(written.columns) == ["answer", "problem", "solution", "source"] and written.count() == 2 * len(rows)


def test_generate_and_compose_jobs(spark):
    d, path, rows = _seed_file(spark, 12)
    gen = providers.synthetic(lambda: F.concat(
        F.lit('{"problem": "new", "answer": "1"}\n{"problem": 2}\n{"problem": "x", "answer": "2"}')))
    lines = run_job(spark, "generate_problem", example_fp=path, provider=gen, output_root=d, output_name="qb",
                    num_example=3, num_generate=3)
    assert lines.where("valid").count() == 2 * 4
    assert spark.read.text(os.path.join(d, "qb.jsonl")).count() == 8
    comp = providers.synthetic(lambda: providers.compose_one_step())
    docs = run_job(spark, "genq_1q1a", example_fp=path, provider=comp, output_root=d, output_name="composed")
    assert docs.where("valid").count() == len(rows)
    back = spark.read.json(os.path.join(d, "composed.jsonl")).collect()
    assert len(back) == len(rows) and all(r.problem.endswith("Then add 1 to the result.") for r in back)


def test_eval_and_exam_jobs(spark):
    d, path, rows = _seed_file(spark, 20)
    prov = providers.synthetic(lambda: F.concat(F.lit("The answer is: "), F.col("answer")))
    acc = run_job(spark, "eval_MATH", test_file=path, provider=prov, output_root=d, output_name="ev").collect()[0]
    assert acc.total == 20 and acc.accuracy == 1.0
    csv = os.path.join(d, "exam.csv")
    with open(csv, "w") as f:
        f.write('Question\n"A\nmultiline one"\n"Second"\n')
    ans = providers.synthetic(lambda: F.concat(F.lit("len="), F.length("prompt").cast("string")))
    out = run_job(spark, "run_exam", exam_path=csv, provider=ans, output_name="exam_out", output_root=d)
    assert out.count() == 2
    assert spark.read.json(os.path.join(d, "exam_out.jsonl")).count() == 2


def _random_provider(spark, kinds):
    """Answers that differ at every evaluation, and a count of the evaluations."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def draw(_):
        calls.add(1)
        return random.choice(kinds)

    def provider(requests):
        return requests.withColumn("content", draw.asNondeterministic()(F.rand()))
    return calls, provider


def test_every_job_calls_its_provider_once_per_request(spark):
    d, path, rows = _seed_file(spark, 40)
    calls, prov = _random_provider(spark, ["The answer is: " + rows[0].answer, "so 7", rows[1].answer])
    out = run_job(spark, "reject_sample", question_fp=path, provider=prov, output_root=d, output_name="r1")
    n = out.count()
    assert calls.value == 120 and spark.read.json(os.path.join(d, "r1.jsonl")).count() == n
    calls, prov = _random_provider(spark, ["The answer is: " + r.answer for r in rows[:3]])
    acc = run_job(spark, "eval_MATH", test_file=path, provider=prov, output_root=d, output_name="e1").first()
    back = spark.read.json(os.path.join(d, "e1.jsonl"))
    assert calls.value == 40 == acc.total and back.where("correct").count() == acc.num_correct
    assert back.where("correct IS NULL").count() == 0
    docs = ['{"problem": "p", "solution": "s", "answer": "1"}', "nothing"]
    calls, prov = _random_provider(spark, docs)
    lines = run_job(spark, "generate_problem", example_fp=path, provider=prov, output_root=d, output_name="g1")
    valid = lines.where("valid").count()
    assert calls.value == 40 and spark.read.text(os.path.join(d, "g1.jsonl")).count() == valid
    calls, prov = _random_provider(spark, docs)
    one = run_job(spark, "genq_1q1a", example_fp=path, provider=prov, output_root=d, output_name="c1")
    valid = one.where("valid").count()
    assert calls.value == 40 and spark.read.text(os.path.join(d, "c1.jsonl")).count() == valid
    csv = os.path.join(d, "exam.csv")
    with open(csv, "w") as f:
        f.write("Question\n" + "\n".join(f"q{i}" for i in range(33)) + "\n")
    calls, prov = _random_provider(spark, ["a", "b", "c", "d"])
    out = run_job(spark, "run_exam", exam_path=csv, provider=prov, output_name="x1", output_root=d)
    want = {r.question: r.answer for r in out.collect()}
    a = {r.question: r.answer for r in spark.read.csv(os.path.join(d, "x1.csv"), header=True, multiLine=True, escape='"').collect()}
    b = {r.question: r.answer for r in spark.read.json(os.path.join(d, "x1.jsonl")).collect()}
    assert calls.value == 33 and a == b == want and len(a) == 33


def test_seed_files_are_read_strictly(spark):
    d = tempfile.mkdtemp(prefix="bw-strict-")
    path = os.path.join(d, "s.jsonl")
    seed = {"level": "3", "problem": "p", "solution": "s", "answer": "1"}
    with open(path, "w") as f:
        f.write("\n" + json.dumps(seed) + "\n" + json.dumps(seed) + "\n\n\n")
    sent = []

    def prov(requests):
        sent.extend(r.user_prompt for r in requests.collect())
        return requests.withColumn("content", F.lit(None).cast("string"))
    run_job(spark, "generate_problem", example_fp=path, provider=prov, output_root=d)
    assert [json.loads(x) for x in sent] == [{k: v for k, v in seed.items() if k != "solution"}] * 2
    with open(path, "a") as f:
        f.write("{broken\n")
    with pytest.raises(Exception, match="malformed JSON on line"):
        run_job(spark, "generate_problem", example_fp=path, provider=prov, output_root=d).collect()


@pytest.mark.parametrize("mode", ["wo_ignore", "ignore", "mix", "concat"])
def test_prepare_rows_job(spark, mode):
    d = tempfile.mkdtemp(prefix="bw-rows-")
    T.sft_pairs(spark, SF001).select("instruction", "output").write.parquet(os.path.join(d, "in", "train"))
    n = spark.read.parquet(os.path.join(d, "in", "train")).count()
    counts = {r.split: r.rows for r in run_job(spark, "prepare_rows", dataset=os.path.join(d, "in"), output_root=os.path.join(d, "out"),
                                               train_mode=mode, n_test=3, max_train=10).collect()}
    if mode != "concat":
        assert counts == {"train": min(10, n - 3), "test": 3}
    out = spark.read.parquet(os.path.join(d, "out", "train"))
    assert {"input_ids", "attention_mask", "labels"} <= set(out.columns) and out.count() == counts["train"]


def test_scratch_scope_deletes(spark):
    from boxwise.session import cut_lineage, scratch_scope
    with scratch_scope(spark):
        df = cut_lineage(spark.range(5))
        files = df.inputFiles()
        assert df.count() == 5 and files
    assert not any(os.path.exists(f.replace("file://", "")) for f in files)


def test_corpus_plan_holds_none_of_its_parts(spark):
    from boxwise.plans import augment
    seeds = T.seeds(spark, SF001)
    part = augment.answer_augmentation(seeds, T.synthetic_attempts)
    corpus = augment.assemble_corpus([part, part])
    plan = corpus._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan
    assert corpus.count() == 2 * part.count() > 0


def test_generated_problems_are_not_broadcast(spark):
    from boxwise.plans import augment, catalog
    rows = augment.question_bootstrapping(T.seeds(spark, SF001), catalog._generation_log(spark, SF001),
                                          T.synthetic_attempts, max_retry=3)
    assert "SortMergeJoin" in (plan := rows._jdf.queryExecution().sparkPlan().toString()) and "BroadcastHashJoin" not in plan


def test_evaluated_items_are_not_broadcast(spark):
    from boxwise.plans import catalog
    plan = catalog.QUERIES["eval_rows"](spark, SF001)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
