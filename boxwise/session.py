"""Session construction and the shared scratch area.

Everything that cuts lineage (``checkpoint``) or writes an intermediate table
goes below ``spark.checkpoint.dir``. On a cluster that setting must name a
shared folder; we only invent one (under the system temp folder) when the
master is local, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []  # paths handed out by scratch_path

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "boxwise", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a temp one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            configured = None
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
        configured = tempfile.mkdtemp(prefix="boxwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint dir for a written intermediate."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/boxwise-{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` evaluated once: written as Parquet to the shared folder and read
    back. Columnar, prunable, and it survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving every intermediate written since entering. Results that
    are still needed must have been written elsewhere by then."""
    start = len(_scratch)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scratch[start:]:
            p = hadoop(path)
            p.getFileSystem(conf).delete(p, True)
        del _scratch[start:]
