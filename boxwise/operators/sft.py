"""Splits, shuffling and training rows.

Modes (T13): ``wo_ignore`` (labels = ids), ``ignore`` (prompt part of the
labels masked with -100), ``mix`` (empty instruction: response only, BOS
dropped, labels = ids; else as ``ignore``; adds ``length``) and ``concat``
(ids of many rows cut into fixed blocks, see ``packing``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.operators import ordinal, packing, prompts, tokens
from boxwise.operators.tokens import BOS_ID, EOS_ID, IGNORE_INDEX

MODES = ("mix", "concat", "ignore", "wo_ignore")
DEFAULT_MAX_LEN = 1024


def hash_key(key: str, salt: str | int) -> Column:
    """Seeded pseudo-random order key (the same in DuckDB: md5 of 'salt|key')."""
    return F.md5(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")))


def train_test_split(df: DataFrame, n_test: int, seed: int, key: str) -> DataFrame:
    """Move exactly ``n_test`` rows (smallest seeded hash) to ``test``.

    Only the boundary row is found (a top-n of ``n_test``, or a global
    numbering when ``n_test`` is large); the split itself is a narrow
    comparison against it, so no join or second shuffle is needed.
    """
    h = df.withColumn("_h", hash_key(key, seed))
    if n_test <= 0:
        return h.withColumn("split", F.lit("train")).drop("_h")
    first = ordinal.first_n(h.select("_h", key), [F.col("_h"), F.col(key)], n_test)
    bound = first.agg(F.max(F.struct("_h", key)).alias("b")).collect()[0]["b"]
    if bound is None:
        return h.withColumn("split", F.lit("test")).drop("_h")
    test = (F.col("_h") < F.lit(bound[0])) | ((F.col("_h") == F.lit(bound[0])) & (F.col(key) <= F.lit(bound[1])))
    return h.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h")


def subsample(df: DataFrame, n: int, salt: str | int, key: str) -> DataFrame:
    """``min(n, count)`` rows in seeded hash order."""
    h = df.withColumn("_h", hash_key(key, salt))
    return ordinal.first_n(h, [F.col("_h"), F.col(key)], n).drop("_h")


def shuffle_rows(df: DataFrame, salt: str | int, key: str, out: str = "row_order") -> DataFrame:
    """A seeded random order as a global 0-based ordinal."""
    h = df.withColumn("_h", hash_key(key, salt))
    return ordinal.with_ordinal(h, [F.col("_h"), F.col(key)], out).drop("_h")


def append_eos(ids: str, max_len: int | None) -> Column:
    """EOS when the last id is not EOS and the row is short of the limit."""
    last = F.try_element_at(F.col(ids), F.lit(-1))
    cond = F.coalesce(last != EOS_ID, F.lit(True))
    if max_len is not None:
        cond = cond & (F.size(ids) < max_len)
    return F.when(cond, F.concat(F.col(ids), F.array(F.lit(EOS_ID)))).otherwise(F.col(ids))


def ones_like(ids: str) -> Column:
    return F.transform(F.col(ids), lambda x: F.lit(1))


def masked_labels(ids: str, k: Column) -> Column:
    """First ``k`` labels -100; a ``k`` past the row lengthens the labels,
    as Python slice assignment does."""
    rest = F.slice(F.col(ids), k + 1, F.greatest(F.size(ids) - k, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), k), rest)


def _prompt_ids_len(text: str, max_len: int) -> Column:
    return F.least(tokens.token_count(text) + 1, F.lit(max_len))


def map_dataset(df: DataFrame, vocab: DataFrame, key: str, mode: str = "mix",
                max_len: int = DEFAULT_MAX_LEN, template: dict | None = None,
                instruction: str = "instruction", output: str = "output",
                batch_rows: int = packing.BATCH_ROWS, shuffle: str | int | None = None) -> DataFrame:
    """Training rows for one mode; other modes fail up front. With a
    ``shuffle`` seed the rows get a random global order first: ``row_order`` in
    the result, and the order in which ``concat`` packs them."""
    if mode not in MODES:
        raise ValueError(f"train mode must be one of {MODES}, got {mode!r}")
    extra: tuple[str, ...] = ()
    if shuffle is not None:
        df, extra = shuffle_rows(df, shuffle, key), ("row_order",)
    r = prompts.render_template(df, template, instruction, output)
    if mode == "concat":
        e = tokens.encode(r, "prompt", vocab, key, "ids", keep=extra).withColumn("ids", append_eos("ids", None))
        return packing.pack_blocks(e, "ids", key, max_len, batch_rows, *extra)
    k = _prompt_ids_len("prompt_wo_response", max_len)
    if mode == "mix":
        empty = F.col(instruction) == ""
        r = r.withColumn("_text", F.when(empty, F.col("response_text")).otherwise(F.col("prompt"))) \
             .withColumn("_empty", empty).withColumn("_k", F.when(empty, F.lit(0)).otherwise(k))
        e = tokens.encode(r, "_text", vocab, key, "ids", max_len, keep=(*extra, "_k", "_empty"))
        e = e.withColumn("ids", F.when(F.col("_empty"), F.slice("ids", 2, max_len)).otherwise(F.col("ids")))
    else:
        r = r.withColumn("_k", k if mode == "ignore" else F.lit(0))
        e = tokens.encode(r, "prompt", vocab, key, "ids", max_len, keep=(*extra, "_k"))
    e = e.withColumn("input_ids", append_eos("ids", max_len))
    length = [F.size("input_ids").alias("length")] if mode == "mix" else []
    return e.select(key, *extra, "input_ids", ones_like("input_ids").alias("attention_mask"),
                    masked_labels("input_ids", F.col("_k")).alias("labels"), *length)


def encode_concat(df: DataFrame, vocab: DataFrame, key: str, template: dict | None = None) -> DataFrame:
    """Whole prompt, no truncation, EOS added if missing."""
    r = prompts.render_template(df, template)
    e = tokens.encode(r, "prompt", vocab, key, "ids")
    return e.select(key, append_eos("ids", None).alias("input_ids"))


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
