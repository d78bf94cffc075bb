"""T4, T5: vocabulary and encoding.

The reference loads a pretrained subword tokenizer. Here tokens are regex
words and single symbols, counted over the corpus: ids 0 (pad/unknown),
1 (BOS), 2 (EOS), then 3... by (count desc, token asc) up to ``vocab_size``.

Encoding plan: the most frequent tokens of the vocabulary, a fixed number of them,
are sent to every task and looked up in place, one lookup of the flattened tokens
for each Arrow batch. They cover nearly all of a text, and what is sent doesn't
grow with the vocabulary. A vocabulary with more entries is joined for the rest:
rows are written with the ids found and the tokens not found; only the latter are
exploded, joined on the token and regrouped by row.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwise.functions.answers import sql_str
from boxwise.operators import ordinal
from boxwise.session import cut_lineage

PAD_ID = 0
UNK_ID = 0
BOS_ID = 1
EOS_ID = 2
FIRST_ID = 3
IGNORE_INDEX = -100
# Letters/digits/underscore runs, or one other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"
# Most entries, and most bytes of one, that are shipped to every task; others are joined.
MAX_BROADCAST_VOCAB = 50_000
MAX_BROADCAST_BYTES = 64


def tokens(text: str) -> Column:
    """Array of regex tokens of a string column (by name)."""
    return F.expr(f"regexp_extract_all(`{text}`, {sql_str(TOKEN_PATTERN)}, 0)")


def token_count(text: str | Column) -> Column:
    if isinstance(text, str):
        return F.size(tokens(text))
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0))


def build_vocab(df: DataFrame, text_cols: list[str], vocab_size: int | None = None) -> DataFrame:
    """T4: (token, id, n) of every token, or with ``vocab_size`` of the most
    frequent ones. Counting is a partial aggregate (hot tokens combine map-side);
    ids come from a global ordinal, or from a top-n where a size is given."""
    if vocab_size is not None and vocab_size <= FIRST_ID:
        raise ValueError("vocab_size must exceed the 3 reserved ids")
    # one pass over the source: the token arrays of all text columns together
    all_tokens = F.concat(*[F.coalesce(tokens(c), F.array().cast("array<string>")) for c in text_cols])
    toks = df.select(F.explode(all_tokens).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("token")]
    if vocab_size is None:
        numbered = ordinal.with_ordinal(counts, order, "_r")
        return numbered.select("token", (F.col("_r") + FIRST_ID).cast("int").alias("id"), "n")
    keep = vocab_size - FIRST_ID
    if keep > ordinal.TOP_N_IN_MEMORY:
        # a large cap: number all distinct tokens without a single-task window
        top = ordinal.first_n(counts, order, keep, name="_r")
        return top.select("token", (F.col("_r") + FIRST_ID).cast("int").alias("id"), "n")
    top = counts.orderBy(*order).limit(keep)
    # the window sees at most `keep` rows (the cap), so one task is enough
    w = Window.orderBy(*order)
    return top.select("token", (F.row_number().over(w) + FIRST_ID - 1).cast("int").alias("id"), "n")


def _sent() -> Column:
    """Which vocabulary entries are sent to every task: those of the least ids, hence
    the most frequent ones of a counted vocabulary."""
    return (F.col("id") < FIRST_ID + MAX_BROADCAST_VOCAB) & (F.octet_length("token") <= MAX_BROADCAST_BYTES)


def _lookup(sent: DataFrame):
    """A function of a token array column that gives the ids, null for a token that
    is not among the ``_sent`` ones."""
    entries = sent.sparkSession.sparkContext.broadcast(sent.toArrow().combine_chunks().to_pydict())

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc
        known = pa.array(entries.value["token"], pa.string())
        numbers = pa.array(entries.value["id"], pa.int32())
        for column in batches:
            place = pc.index_in(column.flatten().cast(pa.string()), known)
            ends = pc.cumulative_sum(pc.list_value_length(column).cast(pa.int32()))
            yield pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), numbers.take(place))

    return ids


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _filled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Id arrays whose nulls are replaced, in order, by the ids of the second array."""
    import pyarrow.compute as pc
    for ids, rest in batches:
        flat = ids.flatten().cast(pa.int32())
        ends = pc.cumulative_sum(pc.list_value_length(ids).cast(pa.int32()))
        full = pc.replace_with_mask(flat, pc.is_null(flat), rest.flatten().cast(pa.int32()))
        yield pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), full)


def _joined_ids(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` (``_tokens``, ``_ids`` with nulls) with the ids of ``others`` in place of
    the nulls, by a join of the tokens that have none."""
    rest = F.transform(F.filter(F.arrays_zip("_tokens", "_ids"), lambda x: x["_ids"].isNull()), lambda x: x["_tokens"])
    # written, as the number of a row must stay
    rows = cut_lineage(rows.withColumn("_rest", rest).drop("_tokens").withColumn("_row", F.monotonically_increasing_id()),
                       "encode")
    toks = rows.select("_row", F.posexplode("_rest").alias("_pos", "token"))
    found = F.struct("_pos", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
    # merge joins: by the size of its compressed files, a table may be broadcast that the driver can't hold
    grouped = toks.join(others.hint("merge"), "token", "left").groupBy("_row").agg(F.array_sort(F.collect_list(found)).alias("_found"))
    ids = F.coalesce(F.transform("_found", lambda x: x["id"]), F.array().cast("array<int>"))
    return rows.drop("_rest").join(grouped.hint("merge"), "_row", "left").withColumn("_ids", _filled("_ids", ids))


def encode(df: DataFrame, text_col: str, vocab: DataFrame, key: str | list[str], out: str = "input_ids",
           max_len: int | None = None, add_bos: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """T5: (key columns, ``keep`` columns, ``out`` = [BOS] + token ids, truncated
    to ``max_len`` ids). A null text has no tokens; ``keep`` is for narrow columns,
    as they are written with the row where the vocabulary is too large to send."""
    keys = [key] if isinstance(key, str) else list(key)
    words = F.coalesce(tokens(text_col), F.array().cast("array<string>"))
    if max_len is not None:
        words = F.slice(words, 1, max_len - (1 if add_bos else 0))
    rows = df.select(*keys, *keep, words.alias("_tokens"))
    vocab = vocab.select("token", "id")
    others = vocab.where(~_sent())
    rows = rows.withColumn("_ids", _lookup(vocab.where(_sent()))("_tokens"))
    if others.isEmpty():
        rows = rows.withColumn("_ids", F.transform("_ids", lambda i: F.coalesce(i, F.lit(UNK_ID))))
    else:
        rows = _joined_ids(rows, others)
    full = F.concat(F.array(F.lit(BOS_ID)), F.col("_ids")) if add_bos else F.col("_ids")
    return rows.select(*keys, *keep, full.cast("array<int>").alias(out))
