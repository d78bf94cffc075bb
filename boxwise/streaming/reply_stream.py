"""C2 as a stream: requests meet their replies as both arrive.

A stream-stream left outer join with watermarks: a request waits in the state until
a reply can no longer come in time, then it is given out without one. The state is
keyed by the request and holds only what lies within the limit and the lateness, so
its size follows the rate of requests, not the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def joined_stream(requests: DataFrame, replies: DataFrame, limit: str, lateness: str, key: str = "request_id",
                  asked: str = "requested_at", answered: str = "answered_at") -> DataFrame:
    """Requests with each reply that came at most ``limit`` (an interval such as
    '180 seconds') after them; null reply columns for a request that had none.
    Streaming or batch, with the same rows. Rows later than ``lateness`` behind the
    newest of their stream may be left out by a stream; a null key or time of a
    request has no reply. Other columns of both sides must have different names."""
    right = replies.withColumnRenamed(key, "_key")
    if requests.isStreaming:
        requests, right = requests.withWatermark(asked, lateness), right.withWatermark(answered, lateness)
    return requests.join(
        right, (F.col(key) == F.col("_key")) & (F.col(answered) >= F.col(asked)) &
        (F.col(answered) <= F.col(asked) + F.expr(f"INTERVAL {limit}")), "left_outer").drop("_key")


def run_reply_stream(spark: SparkSession, requests_dir: str, replies_dir: str, sink_dir: str, checkpoint_dir: str,
                     requests_schema: str, replies_schema: str, limit: str, lateness: str, **names: str) -> None:
    """Processes what is available in the two Parquet folders, appends the settled
    requests to ``sink_dir`` and stops; the next run goes on from the checkpoint with
    the requests that still wait."""
    read = lambda path, schema: spark.readStream.schema(schema).parquet(path)
    joined = joined_stream(read(requests_dir, requests_schema), read(replies_dir, replies_schema), limit, lateness, **names)
    joined.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
