"""Training rows against a brute-force Python version of the reference's
tokenize / mask / pack functions (with the same regex tokenizer)."""
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from boxwise.operators import ordinal, packing, sft, tokens
from boxwise.sources import tables as T
from conftest import SF001

MAXLEN, VOCAB = 24, 300
TOK = regex.compile(tokens.TOKEN_PATTERN)


def pairs(spark, blank_every=None):
    sp = T.sft_pairs(spark, SF001, blank_every)
    return sp.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "instruction", "output")


def py_vocab(rows):
    c = Counter(t for r in rows for s in (r.instruction, r.output) for t in TOK.findall(s))
    top = sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:VOCAB - 3]
    return {t: i + 3 for i, (t, _) in enumerate(top)}


def py_encode(text, vocab, max_len):
    ids = [1] + [vocab.get(t, 0) for t in TOK.findall(text)]
    return ids[:max_len] if max_len else ids


def py_row(ins, out, vocab, mode):
    full = f"{ins}\n\n{out}"
    if mode == "mix" and ins == "":
        ids = py_encode(out, vocab, MAXLEN)[1:]
    else:
        ids = py_encode(full, vocab, MAXLEN)
    if ids[-1] != 2 and len(ids) < MAXLEN:
        ids = ids + [2]
    labels = list(ids)
    if mode == "ignore" or (mode == "mix" and ins != ""):
        k = min(len(py_encode(f"{ins}\n\n", vocab, None)), MAXLEN)
        labels[:k] = [-100] * k
    return ids, labels


@pytest.fixture(scope="module")
def vocab_pair(spark):
    df = pairs(spark)
    v = tokens.build_vocab(df, ["instruction", "output"], VOCAB)
    return v, py_vocab(df.collect())


def test_vocab(spark, vocab_pair):
    v, want = vocab_pair
    assert {r.token: r.id for r in v.collect()} == want


@pytest.mark.parametrize("mode", ["wo_ignore", "ignore", "mix"])
def test_modes(spark, vocab_pair, mode):
    v, pv = vocab_pair
    df = pairs(spark, 3 if mode == "mix" else None)
    got = {r.pair_id: r for r in sft.map_dataset(df, v, "pair_id", mode, MAXLEN).collect()}
    for r in df.collect():
        ids, labels = py_row(r.instruction, r.output, pv, mode)
        g = got[r.pair_id]
        assert g.input_ids == ids and g.labels == labels and g.attention_mask == [1] * len(ids)
        masked = sum(1 for x in g.labels if x == -100)
        assert masked + sum(1 for x in g.labels if x != -100) == len(g.labels)
        if mode == "mix":
            assert g.length == len(ids)


def test_bad_mode(spark, vocab_pair):
    with pytest.raises(ValueError):
        sft.map_dataset(pairs(spark), vocab_pair[0], "pair_id", "pretrain")


@pytest.mark.parametrize("batch_rows", [5, 2000])
def test_pack_blocks_keeps_ids(spark, vocab_pair, batch_rows):
    v, pv = vocab_pair
    df = pairs(spark)
    enc = sft.encode_concat(df, v, "pair_id")
    blocks = packing.pack_blocks(enc, "input_ids", "pair_id", MAXLEN, batch_rows).collect()
    rows = sorted(df.collect(), key=lambda r: r.pair_id)
    want = []
    for b in range(0, len(rows), batch_rows):
        whole = []
        for r in rows[b:b + batch_rows]:
            ids = py_encode(f"{r.instruction}\n\n{r.output}", pv, None)
            whole += ids + ([2] if ids[-1] != 2 else [])
        want += [(b // batch_rows, i // MAXLEN, whole[i:i + MAXLEN]) for i in range(0, len(whole), MAXLEN)]
    got = sorted((r.batch_id, r.block_no, r.input_ids) for r in blocks)
    assert got == sorted(want)


def test_chunks_padding_lengths(spark, vocab_pair):
    v, pv = vocab_pair
    df = pairs(spark)
    r = sft.map_dataset(df, v, "pair_id", "wo_ignore", MAXLEN)
    r = ordinal.with_ordinal(r, ["pair_id"], "o").withColumn("batch_id", F.floor(F.col("o") / 8))
    for row in packing.pad_batches(r, "batch_id").collect():
        assert len(row.input_ids) % 8 == 0
        n_pad = row.attention_mask.count(0)
        assert row.input_ids[:n_pad] == [0] * n_pad and row.labels[:n_pad] == [-100] * n_pad
    enc = tokens.encode(df, "output", v, "pair_id", "ids")
    for row in packing.chunk_overflow(enc, "ids", 7, keep=("pair_id", "ids")).collect():
        start = row.chunk_no * 7
        piece = row.ids[start:start + 7]
        if start + 7 >= len(row.ids) and len(piece) < 7 and piece[-1] != 2:
            piece = piece + [2]
        assert row.chunk == piece


def test_splits(spark):
    df = pairs(spark)
    s = sft.train_test_split(df, 10, 42, "pair_id")
    counts = {r.split: r.rows for r in sft.split_counts(s).collect()}
    assert counts["test"] == 10 and counts["train"] == df.count() - 10
    assert sft.subsample(df, 7, 1, "pair_id").count() == 7
    o = [r.row_order for r in sft.shuffle_rows(df, 1, "pair_id").collect()]
    assert sorted(o) == list(range(df.count()))


@pytest.mark.parametrize("parts", [1, 8])
def test_ordinal_same_for_any_partitioning(spark, parts):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(parts)
    got = sorted((r.ordinal, r.k) for r in ordinal.with_ordinal(df, ["k"], partitions=parts).collect())
    assert got == [(i, i) for i in range(1000)]
    top = ordinal.first_n(df, [F.col("k")], 10, name="o").collect()
    assert sorted(r.k for r in top) == list(range(10))


def test_ordinal_spreads_a_hot_key(spark):
    """A third of the rows share one order key: they still land in several
    range partitions and the numbering stays a permutation."""
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"),
                                     F.col("id"))
    o = ordinal.with_ordinal(df, ["k"], partitions=8)
    parts = o.select(F.spark_partition_id().alias("p"), "k").where("k = 5").select("p").distinct().count()
    assert parts > 1
    got = [r.ordinal for r in o.orderBy("ordinal").collect()]
    assert got == list(range(3000))
    ks = [r.k for r in o.orderBy("ordinal").collect()]
    assert ks == sorted(ks)


def test_previous_row_matches_lag(spark):
    from pyspark.sql import Window
    from boxwise.operators.sequence import previous_row
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 5000).alias("t"),
                                     F.col("id").cast("string").alias("v"))
    df = df.where(F.col("k") != 2).unionByName(df.where("k = 2").limit(5))
    got = previous_row(df, "k", "t", ["v"], chunk=64)
    want = df.withColumn("prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    assert sorted(tuple(r) for r in got.select("k", "t", "prev_v").collect()) == \
        sorted(tuple(r) for r in want.select("k", "t", "prev_v").collect())


def test_vocabulary_without_a_cap_and_joined_lookup(spark, monkeypatch):
    df = pairs(spark)
    v = tokens.build_vocab(df, ["instruction", "output"])
    c = Counter(t for r in df.collect() for s in (r.instruction, r.output) for t in TOK.findall(s))
    assert [r.token for r in v.orderBy("id").collect()] == sorted(c, key=lambda t: (-c[t], t))
    want = {r.pair_id: r.ids for r in tokens.encode(df, "output", v, "pair_id", "ids").collect()}
    monkeypatch.setattr(tokens, "MAX_BROADCAST_VOCAB", 5)
    assert {r.pair_id: r.ids for r in tokens.encode(df, "output", v, "pair_id", "ids").collect()} == want


def test_vocabulary_entries_sent_are_bounded(spark, monkeypatch):
    v = spark.range(60_000).select(F.concat(F.lit("w"), F.col("id")).alias("token"), (F.col("id") + 3).cast("int").alias("id"))
    v = v.union(spark.createDataFrame([("x" * 100, 4_000_000)], "token string, id int"))
    sent, collect = [], type(v).toArrow

    def counted(self):
        table = collect(self)
        sent.append(table.num_rows)
        return table

    monkeypatch.setattr(type(v), "toArrow", counted)
    texts = ["w1 w59999 ? w2 w50000 w59999", "", None, "w49999 " + "x" * 100 + " ? ?", "w59998"]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "k int, t string")
    got = sorted(r.ids for r in tokens.encode(df, "t", v, "k", "ids", add_bos=False).collect())
    rows = tokens.encode(df, "t", v, "k", "ids")
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().sparkPlan().toString()
    assert got == [[], [], [4, 60002, 0, 5, 50003, 60002], [50002, 4_000_000, 0, 0], [60001]]
    assert max(sent) <= 50_000


def test_composite_keys_and_empty_texts(spark):
    df = spark.createDataFrame([(1, 1000, "a b"), (2, 0, "c"), (2, 1, ""), (2, 2, None)], "conv int, turn int, t string")
    v = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "token string, id int")
    got = {(r.conv, r.turn): r.ids for r in tokens.encode(df, "t", v, ["conv", "turn"], "ids").collect()}
    assert got == {(1, 1000): [1, 3, 4], (2, 0): [1, 5], (2, 1): [1], (2, 2): [1]}


def test_first_n_same_rows_either_way(spark, monkeypatch):
    df = spark.range(0, 500).select((F.col("id") * 37 % 500).alias("k"))
    want = sorted(r.k for r in ordinal.first_n(df, [F.col("k")], 60).collect())
    monkeypatch.setattr(ordinal, "TOP_N_IN_MEMORY", 10)
    assert sorted(r.k for r in ordinal.first_n(df, [F.col("k")], 60).collect()) == want == list(range(60))


def test_shuffled_concat_packs_in_row_order(spark, vocab_pair):
    v, pv = vocab_pair
    df = pairs(spark)
    order = {r.pair_id: r.row_order for r in sft.shuffle_rows(df, 9, "pair_id").collect()}
    whole = []
    for r in sorted(df.collect(), key=lambda r: order[r.pair_id]):
        ids = py_encode(f"{r.instruction}\n\n{r.output}", pv, None)
        whole += ids + ([2] if ids[-1] != 2 else [])
    blocks = sft.map_dataset(df, v, "pair_id", "concat", MAXLEN, shuffle=9).orderBy("batch_id", "block_no").collect()
    assert [i for b in blocks for i in b.input_ids] == whole


def test_encoding_in_place_moves_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "b zz"), (None, "a"), (2, None)], "k int, t string")
    v = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    e = tokens.encode(df, "t", v, "k", "ids", max_len=3)
    assert sorted(((r.k or 0), r.ids) for r in e.collect()) == [(0, [1, 3]), (1, [1, 3, 4]), (1, [1, 4, 0]), (2, [1])]
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert tokens.encode(df.limit(0), "t", v, "k").count() == 0
    assert {tuple(r.ids) for r in tokens.encode(df, "t", v.limit(0), "k", "ids", add_bos=False).collect()} == {(0, 0), (0,), ()}
