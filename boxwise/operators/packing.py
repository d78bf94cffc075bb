"""Packing, chunking, padding and length batches.

Packing (T11) joins the ids of ``batch_rows`` consecutive rows and cuts the
run into blocks of ``block`` ids, keeping the short last block. No batch is
collected whole: each row learns its offset inside its batch (a running sum
of lengths), emits one slice per block it overlaps, and slices are regrouped
by (batch, block) -- so every group holds at most ``block`` ids however long
the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.operators import ordinal
from boxwise.operators.tokens import EOS_ID, IGNORE_INDEX, PAD_ID

BATCH_ROWS = 2000
PAD_MULTIPLE = 8


def pack_blocks(df: DataFrame, ids: str, order_col: str, block: int,
                batch_rows: int = BATCH_ROWS, ordinal_col: str | None = None) -> DataFrame:
    """(batch_id, block_no, input_ids, attention_mask, labels).

    Rows are taken in ``order_col`` order (a global ordinal is computed
    unless ``ordinal_col`` already holds one).
    """
    if ordinal_col is None:
        df = ordinal.with_ordinal(df.select(order_col, ids), [order_col], "_ord")
        ordinal_col = "_ord"
    d = df.select(F.col(ordinal_col).alias("_ord"), F.col(ids).alias("_ids"))
    d = d.withColumn("batch_id", F.floor(F.col("_ord") / batch_rows).cast("bigint"))
    w = (Window.partitionBy("batch_id").orderBy("_ord")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_len", F.size("_ids")).withColumn("_end", F.sum("_len").over(w)) \
         .withColumn("_start", F.col("_end") - F.col("_len")).where(F.col("_len") > 0)
    first_b = F.floor(F.col("_start") / block)
    last_b = F.floor((F.col("_end") - 1) / block)
    d = d.select("batch_id", "_ord", "_ids", "_start",
                 F.explode(F.sequence(first_b, last_b)).alias("block_no"))
    lo = F.greatest(F.col("block_no") * block, F.col("_start"))
    hi = F.least((F.col("block_no") + 1) * block, F.col("_start") + F.size("_ids"))
    d = d.select("batch_id", "block_no", "_ord",
                 F.slice("_ids", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias("_piece"))
    g = d.groupBy("batch_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("_ord", "_piece"))).alias("_p"))
    ids_col = F.flatten(F.transform("_p", lambda x: x["_piece"]))
    return g.select(F.col("batch_id"), F.col("block_no").cast("bigint"), ids_col.alias("input_ids")) \
        .withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1))) \
        .withColumn("labels", F.col("input_ids"))


def chunk_overflow(df: DataFrame, ids: str, block: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut each row in chunks of ``block``; EOS on a short last chunk that
    does not end with EOS."""
    n = F.size(ids)
    n_chunks = F.when(n > 0, F.floor((n - 1) / block) + 1).otherwise(F.lit(0))
    d = df.select(*keep, F.col(ids).alias("_ids"), n_chunks.alias("_nc"))
    d = d.select(*keep, "_ids", "_nc", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("chunk_no")) \
         .where(F.col("_nc") > 0)
    chunk = F.slice("_ids", (F.col("chunk_no") * block + 1).cast("int"), block)
    d = d.withColumn("chunk", chunk)
    is_last = F.col("chunk_no") == F.col("_nc") - 1
    fix = is_last & (F.size("chunk") < block) & (F.try_element_at("chunk", F.lit(-1)) != EOS_ID)
    d = d.withColumn("chunk", F.when(fix, F.concat("chunk", F.array(F.lit(EOS_ID)))).otherwise(F.col("chunk")))
    return d.select(*keep, F.col("chunk_no").cast("bigint"), "chunk")


def pad_left(col: str, width: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), (width - F.size(col)).cast("int")), F.col(col))


def pad_batches(df: DataFrame, batch_col: str, multiple: int = PAD_MULTIPLE, pad_id: int = PAD_ID) -> DataFrame:
    """Left-pad each batch to a multiple of ``multiple`` of its longest
    row: ids with ``pad_id``, mask with 0, labels with -100.

    Batches hold a handful of rows, so the batch width is a window max over
    the batch (one shuffle on the batch id; every window group is small).
    """
    w = Window.partitionBy(batch_col)
    width = (F.ceil(F.max(F.size("input_ids")).over(w) / multiple) * multiple).cast("int")
    d = df.withColumn("_w", width)
    return d.select(*[c for c in df.columns if c not in ("input_ids", "attention_mask", "labels")],
                    pad_left("input_ids", F.col("_w"), pad_id).alias("input_ids"),
                    pad_left("attention_mask", F.col("_w"), 0).alias("attention_mask"),
                    pad_left("labels", F.col("_w"), IGNORE_INDEX).alias("labels"))


def length_batches(df: DataFrame, key: str, length_col: str = "length", batch_size: int = 8) -> DataFrame:
    """Rows of like length together: global order by (length desc, key),
    then ``batch_size`` consecutive rows per batch."""
    o = ordinal.with_ordinal(df, [F.col(length_col).desc(), F.col(key)], "_lord")
    return o.withColumn("batch_id", F.floor(F.col("_lord") / batch_size).cast("bigint")).drop("_lord")
