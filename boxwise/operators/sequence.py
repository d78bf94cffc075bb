"""The previous row of each row within a group, without one task per group.

``lag`` over ``PARTITION BY key ORDER BY order`` puts a whole group in one
window partition. Here the order range is cut into chunks:

1. ``lag`` runs over (key, chunk) -- every window partition holds at most
   ``chunk`` distinct order values;
2. each chunk's last row is a partial ``max_by`` aggregate;
3. the first row of a chunk takes the last row of the nearest earlier
   chunk (a ``lag`` over the chunk table, which is ``chunk`` times smaller)
   through a join on (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024


def previous_row(df: DataFrame, key: str, order: str, cols: list[str], chunk: int = CHUNK,
                 prefix: str = "prev_") -> DataFrame:
    """Add ``<prefix><c>``: the value of ``c`` in the previous row by ``order``
    within ``key`` (null for the first row), for each ``c`` in ``cols``."""
    d = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    w = Window.partitionBy(key, "_chunk").orderBy(order)
    for c in cols:
        d = d.withColumn(f"_lag_{c}", F.lag(c).over(w))
    d = d.withColumn("_first", F.row_number().over(w) == 1)
    last = d.groupBy(key, "_chunk").agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_last"))
    wl = Window.partitionBy(key).orderBy("_chunk")
    before = last.select(key, "_chunk", F.lag("_last").over(wl).alias("_before"))
    d = d.join(before, [key, "_chunk"], "left")
    for c in cols:
        d = d.withColumn(f"{prefix}{c}", F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"_lag_{c}")))
    return d.drop("_chunk", "_first", "_before", *[f"_lag_{c}" for c in cols])
