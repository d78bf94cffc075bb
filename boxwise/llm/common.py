"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxwise.session import scratch_path, scratch_scope


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read
    back: cuts lineage, freezes partition numbers and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def distilled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` written once; the intermediates that it wrote on the
    way are deleted then, as nothing reads them any more."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the ``edges`` (a, b), root being the least
    node of its connected component.

    Each round replaces both ends of every edge by the least neighbour seen
    (partial aggregates, no group is collected), keeps the edges that still join
    two roots, and writes them; the number of rounds grows with the logarithm of
    the longest chain. Nothing but one count per round reaches the driver.
    """
    live = edges.select("a", "b").where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = written(live, f"{name}-edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    label = written(nodes.select("node", F.col("node").alias("root")), f"{name}-label0")
    step = 0
    while not live.isEmpty():
        step += 1
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # every root points at the least of itself and its neighbours, then
        # pointers are followed to their ends by repeated doubling
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("up"))
        parent = written(parent, f"{name}-parent{step}")
        while True:
            up = parent.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            nxt = written(parent.join(up, "up", "left").select(
                "node", F.coalesce("up2", "up").alias("new"), F.col("up").alias("old")), f"{name}-jump")
            moved = not nxt.where("new <> old").isEmpty()
            parent = nxt.select("node", F.col("new").alias("up"))
            if not moved:
                break
        move = parent.where("node <> up")
        label = written(label.join(move.select(F.col("node").alias("root"), "up"), "root", "left").select(
            "node", F.coalesce("up", "root").alias("root")), f"{name}-label{step}")
        live = written(
            live.join(move.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a", "left")
                .join(move.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b", "left")
                .select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
                .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"{name}-edges{step}")
    return label
