"""Prompts, JSON text and requests against Python's json and str.format."""
import json

import pytest
from pyspark.sql import functions as F

from boxwise.functions.text import json_string
from boxwise.operators import prompts, requests
from boxwise.resources import texts
from boxwise.sources import tables as T
from conftest import SF001


def test_json_string_matches_python(spark):
    samples = ["plain", 'q"uote\\back', "tab\tnl\ncr\rbs\bff\f", "\x00\x1f\x7f", "é ü ß", "😀 astral", ""]
    conv = [r.text for r in T.load(spark, SF001, "conversations").limit(50).collect()]
    vals = samples + conv
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    got = {r.i: r.j for r in df.select("i", F.expr(json_string("s")).alias("j")).collect()}
    for i, v in enumerate(vals):
        assert got[i] == json.dumps(v)


def test_seed_json_and_batches(spark):
    seeds = T.seeds(spark, SF001)
    rows = {r.problem_id: r for r in seeds.collect()}
    got = prompts.seed_json(seeds, add_sol=False, add_ans=True).collect()
    for r in got:
        assert r.seed_json == json.dumps({"problem": rows[r.problem_id].problem, "answer": rows[r.problem_id].answer,
                                          "subject": rows[r.problem_id].subject})
    b = prompts.batch_seeds(seeds, 4, add_sol=True, add_ans=True).orderBy("batch_id").collect()
    ids = sorted(rows)
    assert len(b) == len(ids) // 4
    first = b[0]
    want = "\n".join(json.dumps({"problem": rows[i].problem, "solution": rows[i].solution,
                                 "answer": rows[i].answer, "subject": rows[i].subject}) for i in ids[:4])
    assert first.user_prompt == want and first.first_id == ids[0]


def test_exam_prompts(spark):
    df = spark.createDataFrame([("What is 1+1?",)], "question string")
    for style, fmt in texts.EXAM_STYLES.items():
        p = prompts.exam_prompts(df, style).collect()[0].prompt
        if style == "few_shot":
            assert p == texts.few_shot_text() + "\n\nProblem:\nWhat is 1+1?\n\nSolution:\n"
            assert "\x0crac" in p and r"\times" not in p and "\timesr" not in p
        else:
            assert p == fmt.format(question="What is 1+1?")
    with pytest.raises(ValueError):
        prompts.exam_prompts(df, "unknown")


def test_render_template_and_system_prompts(spark):
    df = spark.createDataFrame([("I {x}", "O")], "instruction string, output string")
    t = {"prompt": "{{lit}} {instruction}|{response}", "instruction": "{instruction}",
         "response": "{response}", "prompt_wo_response": "{instruction}\n\n"}
    r = prompts.render_template(df, t).collect()[0]
    assert r.prompt == "{lit} I {x}|O" and r.prompt_wo_response == "I {x}\n\n"
    assert "{num_example}" not in prompts.system_prompt("qb", 1, 5)
    assert "{num_example}" in prompts.system_prompt("compose_init")
    assert prompts.system_prompt("cot") == texts.SYSTEM_PROMPTS["cot"]


def test_threads_and_requests(spark):
    df = spark.createDataFrame([(1, "p1", "r1"), (2, "p2", None)], "problem_id long, problem string, response string")
    t = requests.build_threads(df, "problem", "SYS", "response")
    t = t.withColumn("reset", requests.reset_threads("messages")) \
         .withColumn("warn", requests.last_role_is_assistant("messages"))
    rows = {r.problem_id: r for r in t.collect()}
    assert [m.role for m in rows[1].messages] == ["system", "user", "assistant"]
    assert [m.role for m in rows[1].reset] == ["system"] and rows[1].warn
    req = requests.build_requests(requests.build_threads(df, "problem", "SYS"), "t", ["problem_id"])
    r = req.where("problem_id = 1").collect()[0]
    body = json.loads(r.body_json)
    assert body["messages"] == [{"role": "system", "content": "SYS"}, {"role": "user", "content": "p1"}]
    assert body["model"] == "gpt-4-1106-preview" and body["max_tokens"] == 2048 and body["stream"] is False
    assert len(r.request_id) == 32
    assert req.select(requests.short_id().alias("s")).first().s in {x.request_id[:10] for x in req.collect()}


def test_json_null_like_python(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(F.expr(json_string("s")).alias("j")).collect()[0].j == json.dumps(None)


def test_raw_seed_lines_keep_keys_and_order(spark):
    seeds = [{"level": "5", "problem": "é?", "type": "x", "solution": "s", "answer": "1"}, {"answer": "2", "problem": "p", "solution": "", "n": 3}]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(seeds)], "i int, value string")
    for add_sol, add_ans in ((True, True), (False, True), (False, False)):
        got = {r.i: r.j for r in df.select("i", prompts.raw_seed_json("value", add_sol, add_ans).alias("j")).collect()}
        for i, s in enumerate(seeds):
            assert got[i] == json.dumps({k: v for k, v in s.items() if (k != "solution" or add_sol) and (k != "answer" or add_ans)})


def test_named_templates_and_providers():
    from boxwise.operators import providers
    with pytest.raises(KeyError):
        texts.register_template("half", {"prompt": "x"})
    texts.register_template("copy", texts.load_template())
    assert texts.load_template("copy") == texts.load_template()
    providers.register_provider("same", lambda d: d)
    assert providers.get_provider("same")(1) == 1
    with pytest.raises(KeyError):
        providers.get_provider("missing")
