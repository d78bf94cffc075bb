"""Global row numbers and first-n selection without a single-task window.

``row_number() OVER (ORDER BY k)`` moves every row to one task. Instead:

1. range-partition on the order key and sort inside each partition (one
   shuffle; the sampled bounds balance the partitions);
2. write the rows with their partition and their place in it to the shared
   folder, so both are fixed even after executor loss;
3. count rows per partition (one row each), turn the counts into offsets, and
   add ``offset[partition] + position`` through a broadcast of that table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwise.session import cut_lineage

# Above this many rows a first-n selection numbers all rows instead of
# keeping n rows per task in a top-n heap. Both give the same rows.
TOP_N_IN_MEMORY = 100_000


def _num_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_ordinal(df: DataFrame, order_cols: list[str | Column], name: str = "ordinal",
                 partitions: int | None = None, presorted: bool = False) -> DataFrame:
    """Add a 0-based global row number in ``order_cols`` order (ties: any order).

    ``presorted=True`` keeps the current partitions and their row order (for
    a frame read in file order); otherwise rows are range-partitioned first.
    """
    if presorted:
        ranged = df
    else:
        # A hash of the whole row breaks ties, so a key shared by a large part
        # of the rows is still spread over several range partitions.
        hashable = [F.col(f.name) for f in df.schema.fields
                    if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        keys = list(order_cols) + ([F.xxhash64(*hashable)] if hashable else [])
        ranged = df.repartitionByRange(_num_partitions(df, partitions), *keys).sortWithinPartitions(*keys)
    pos = ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mid"))
    pos = cut_lineage(pos.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_part").cast("bigint"), 33)), "ordinal")
    sizes = sorted(pos.groupBy("_part").count().collect())  # one row per partition
    starts = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)], "_part int, _offset bigint")
    return pos.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_pos")).select(
        *df.columns, name)


def first_n(df: DataFrame, order_cols: list[str | Column], n: int, name: str | None = None) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order (a sampling operator).

    Small ``n``: a top-n (each task keeps n rows). Large ``n``: number all
    rows with ``with_ordinal`` and filter, so no task holds n rows.
    """
    if n <= 0:
        return df.limit(0)
    if n <= TOP_N_IN_MEMORY and name is None:
        return df.orderBy(*order_cols).limit(n)
    numbered = with_ordinal(df, order_cols, name or "_ordinal")
    out = numbered.where(F.col(name or "_ordinal") < n)
    return out if name else out.drop("_ordinal")
