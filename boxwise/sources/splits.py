"""S3: a dataset folder with ``train`` and optional ``test`` splits."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, root: str, split_col: str = "split", fmt: str = "parquet") -> None:
    for name in ("train", "test"):
        part = df.where(F.col(split_col) == name).drop(split_col)
        part.write.mode("overwrite").format(fmt).save(f"{root.rstrip('/')}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def load_splits(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """``{"train": df, "test": df}``; ``test`` only when present."""
    out = {}
    for name in ("train", "test"):
        path = f"{root.rstrip('/')}/{name}"
        if _exists(spark, path):
            out[name] = spark.read.format(fmt).load(path)
    if "train" not in out:
        raise FileNotFoundError(os.path.join(root, "train"))
    return out
