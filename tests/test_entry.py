"""The driver contract and whole-job checks on sf0.001."""
import pytest

import __spark_entry__ as E
from boxwise.plans import catalog
from conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["num_correct", "total", "accuracy"]
    assert rows[0].total == 6000 and rows[0].accuracy == 0.8


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


@pytest.mark.parametrize("name", ["accuracy", "reject_sample", "resolve_attempts", "batch_seeds",
                                  "question_bootstrapping", "labels_mix", "pack_blocks"])
def test_same_result_for_1_and_8_partitions(spark, name):
    out = {}
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = E.queries()[name](spark, SF001)
        out[parts] = sorted(repr(tuple(r)) for r in df.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out["1"] == out["8"]


def test_corpus_subsets(spark):
    c = catalog.QUERIES["assemble_corpus"](spark, SF001)
    subsets = {r.subset for r in c.select("subset").distinct().collect()}
    assert subsets == {"answer_augmentation", "question_bootstrapping", "similar_problems",
                       "compose_iter0", "compose_iter1"}
    pairs = catalog.QUERIES["to_instruction_pairs"](spark, SF001)
    assert pairs.count() == c.count()
