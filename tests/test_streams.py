"""Streams with state and several sinks: equal to the batch, restarts included."""
import datetime as dt

from pyspark.sql import functions as F

from boxwise.session import scratch_path
from boxwise.streaming import line_sinks as LS, reply_stream as RS

ASKED, REPLIES = "request_id string, requested_at timestamp", "request_id string, content string, answered_at timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_reply_stream_equals_the_batch_join(spark):
    asked = [("in time", at(0)), ("twice", at(1)), ("at the limit", at(2)), ("too late", at(3)), ("none", at(4)),
             (None, at(5)), ("before", at(9))]
    replies = [[("in time", "a", at(2)), ("before", "x", at(8))],
               [("twice", "b", at(2)), ("twice", "c", at(4)), ("at the limit", "d", at(5)), ("too late", "e", at(7)),
                ("nobody", "f", at(4)), (None, "g", at(6))]]
    src, sink, ck = (scratch_path(spark, n) for n in ("t-reply-src", "t-reply-sink", "t-reply-ckpt"))
    drops = [(asked, replies[0]), ([], replies[1]), ([("end", at(5000))], [("end", None, at(5000))])]
    for a, r in drops:  # the second run goes on from the state of the first
        spark.createDataFrame(a, ASKED).write.mode("append").parquet(src + "/a")
        spark.createDataFrame(r, REPLIES).write.mode("append").parquet(src + "/r")
        RS.run_reply_stream(spark, src + "/a", src + "/r", sink, ck, ASKED, REPLIES, "3 minutes", "1 day")
    got = sorted((str(r.request_id), str(r.content)) for r in spark.read.parquet(sink).collect() if r.request_id != "end")
    batch = RS.joined_stream(spark.createDataFrame(asked, ASKED), spark.createDataFrame(replies[0] + replies[1], REPLIES),
                             "3 minutes", "1 day")
    assert got == sorted((str(r.request_id), str(r.content)) for r in batch.collect())
    assert ("at the limit", "d") in got and ("too late", "None") in got and ("before", "None") in got and len(got) == 8


def test_a_batch_run_twice_adds_no_row(spark):
    root = scratch_path(spark, "t-sinks")
    good, bad = '{"problem": "p", "answer": "1"}', '{"problem": 1}'
    df = spark.createDataFrame([("t", 1, f"{good}\n{bad}\n{good}"), ("t", 2, None), ("u", 3, "no")], LS.RESPONSES)
    for _ in range(2):
        LS.write_batch(df, 0, root)
    LS.write_batch(df.limit(0), 1, root)
    assert sorted((r.batch_id, r.line_no) for r in LS.read_sink(spark, root, "results").collect()) == [(1, 0), (1, 2)]
    assert sorted((r.batch_id, r.reason) for r in LS.read_sink(spark, root, "rejects").collect()) == [
        (1, "problem_not_string"), (3, "not_json")]
    assert sorted(tuple(r) for r in LS.read_sink(spark, root, "counts").select("task", "responses", "lines", "valid").collect()) == [
        ("t", 2, 3, 2), ("u", 1, 1, 0)]
    # a batch that broke off before its entry in the manifest is not seen
    df.select("task", "batch_id", F.lit(0).alias("line_no"), F.lit("x").alias("line")).write.parquet(f"{root}/results/micro_batch=2")
    assert LS.read_sink(spark, root, "results").count() == 2


def test_line_sinks_go_on_after_a_restart(spark):
    src, root, ck = (scratch_path(spark, n) for n in ("t-ls-src", "t-ls", "t-ls-ckpt"))
    for part in range(2):
        rows = [("t", part * 10 + i, '{"problem": "p", "answer": "1"}\nx') for i in range(6)]
        spark.createDataFrame(rows, LS.RESPONSES).coalesce(2).write.mode("append").json(src)
        LS.run_line_sinks(spark, src, root, ck, max_files=1)
    for name in ("results", "rejects"):
        assert LS.read_sink(spark, root, name).count() == 12
    assert LS.read_sink(spark, root, "counts").agg(F.sum("responses"), F.sum("valid")).first()[:] == (12, 12)
