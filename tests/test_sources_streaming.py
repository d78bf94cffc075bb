"""Sources, sinks and streaming (stream result = batch result)."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from boxwise.operators import verify
from boxwise.session import scratch_path
from boxwise.sources import exam, jsonl, splits, tables as T
from boxwise.streaming import verify_stream as WS
from conftest import SF001


def test_read_jsonl_slices_like_python(spark):
    d = tempfile.mkdtemp(prefix="bw-jsonl-")
    lines = [json.dumps({"problem": f"p{i}", "answer": str(i)}) for i in range(40)]
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        for i, line in enumerate(lines):
            f.write(line + "\n" + ("\n   \n" if i % 5 == 0 else ""))
    for start, end in [(0, None), (3, 10), (-7, None), (5, -5), (30, 100)]:
        got = [r.problem for r in jsonl.read_jsonl(spark, d, "problem string, answer string", start, end)
               .orderBy("line_no").collect()]
        assert got == [json.loads(x)["problem"] for x in lines][start:end], (start, end)


def test_exam_csv_multiline(spark):
    d = tempfile.mkdtemp(prefix="bw-csv-")
    qs = ['Line one\nline two, with "quotes"', "Plain", 'A\n\nB "C"\nD']
    path = os.path.join(d, "exam.csv")
    with open(path, "w") as f:
        f.write("Question\n" + "".join('"' + q.replace('"', '""') + '"\n' for q in qs))
    got = [r.question for r in exam.read_exam_csv(spark, path).collect()]
    assert sorted(got) == sorted(qs)
    assert spark.read.csv(path, header=True).count() > len(qs)  # default options split the cells


def test_splits_and_append(spark):
    df = spark.createDataFrame([(i, "train" if i % 4 else "test") for i in range(20)], "k int, split string")
    root = scratch_path(spark, "t-splits")
    splits.write_splits(df, root)
    parts = splits.load_splits(spark, root)
    assert parts["train"].count() == 15 and parts["test"].count() == 5
    path = scratch_path(spark, "t-append")
    jsonl.append_jsonl(df, path)
    jsonl.append_jsonl(df, path)
    assert spark.read.json(path).count() == 40


def test_stream_verify_equals_batch(spark):
    a = T.attempts(spark, SF001)
    src, sink, ck = (scratch_path(spark, n) for n in ("t-src", "t-sink", "t-ck"))
    a.where("attempt = 0").write.json(src + "/0")
    schema = "problem_id BIGINT, problem STRING, answer STRING, attempt INT, response STRING"
    src_glob = src + "/*"
    WS.run_verify_stream(spark, src_glob, sink, ck, schema, keep=("problem_id", "attempt"))
    a.where("attempt > 0").write.json(src + "/1")
    WS.run_verify_stream(spark, src_glob, sink, ck, schema, keep=("problem_id", "attempt"))
    streamed = sorted(tuple(r) for r in spark.read.parquet(sink).select("problem_id", "attempt", "model_answer", "correct").collect())
    batch = verify.verify_answers(verify.extract_answers(a, "response", "model_answer"))
    want = sorted(tuple(r) for r in batch.select("problem_id", "attempt", "model_answer", "correct").collect())
    assert streamed == want


def test_line_order_across_splits_and_files(spark):
    d = tempfile.mkdtemp(prefix="bw-lines-")
    want = []
    for f in ("part-a.jsonl", "part-b.jsonl"):
        rows = [json.dumps({"problem": f"{f}-{i}", "answer": str(i)}) for i in range(300)]
        want += [json.loads(r)["problem"] for r in rows]
        with open(os.path.join(d, f), "w") as fh:
            fh.write("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = jsonl.read_jsonl(spark, d, "problem string, answer string")
        assert spark.read.text(d).rdd.getNumPartitions() > 4
        got = [r.problem for r in df.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want
