"""Whitening of embeddings with distributed block matrices.

1. One aggregate gives the number of vectors and the exact sum of every dimension.
2. Rows are numbered without gaps in the order they were read (their place in their
   partition plus the counts of the partitions in front).
3. Centred rows become an ``IndexedRowMatrix`` and from there blocks of bounded size;
   transpose times blocks is the scatter, its middle dimension split over many tasks
   so that no task sees more than its share of the blocks.
4. The covariance, dimensions squared, is decomposed on the driver.
5. Blocks times the whitening matrix project the rows, which are joined back to
   their ids by number.

The driver of a block product holds the coordinates of all blocks, so at most
``BLOCKS_AT_ONCE`` blocks are multiplied in one go; scatters of the parts add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from boxwise.llm.common import shuffle_partitions, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK_BYTES = 2 << 20      # of a block of doubles
BLOCKS_TOGETHER = 8        # blocks of a side that meet in a task of the scatter
BLOCKS_AT_ONCE = 1 << 15   # whose coordinates the driver holds
NULL_SPACE = 1e-12         # eigenvalues up to this share of the largest are taken as 0
LOW = 1 << 31              # integers are summed as high and low parts


def fit_list(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(index, vec_id, x): the usable vectors as integers and a number of their own.

    A vector is usable if it is not null, holds no null, no NaN and no infinity, and
    has the length that most such vectors have (of several such lengths the longest;
    an empty vector is never usable). ``x`` is ``floor(64 * c) + 1000000`` of each
    entry, within the range of 64 bits. Numbers start at 0; they have gaps where
    vectors of another length stood."""
    clean = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) &
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    most = float(1 << 62)
    rows = written(clean.select(
        "vec_id", F.transform("v", lambda c: F.floor(
            F.greatest(F.least(c * SCALE, F.lit(most)), F.lit(-most))).cast("bigint") + OFFSET).alias("x"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "white-clean")
    rows = rows.withColumn("place", F.col("place") - F.shiftleft(F.col("part").cast("bigint"), 33))
    sizes = sorted(rows.groupBy("part").agg((F.max("place") + 1).alias("n")).collect())  # one row a partition
    offsets = vectors.sparkSession.createDataFrame(
        list(zip([p for p, _ in sizes], [0, *accumulate(n for _, n in sizes)])), "part int, ahead bigint")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0)).join(F.broadcast(offsets), "part").select(
        (F.col("ahead") + F.col("place")).alias("index"), "vec_id", "x")


def _matrix(column):
    """The rows of an Arrow list column of equal lengths as a numpy matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _integer_sums(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            high = x >> 31
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x)]), pa.array([high.sum(0).tolist()], pa.list_(pa.int64())),
                 pa.array([(x - (high << 31)).sum(0).tolist()], pa.list_(pa.int64()))], names=["n", "high", "low"])


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""
    parts = written(rows.select("x").mapInArrow(_integer_sums, "n bigint, high array<bigint>, low array<bigint>"), "white-sums")
    n = parts.agg(F.sum("n")).first()[0] or 0
    sums = parts.select(F.posexplode(F.arrays_zip("high", "low"))).groupBy("pos").agg(
        F.sum(F.col("col.high").cast("decimal(38,0)")), F.sum(F.col("col.low").cast("decimal(38,0)"))).orderBy("pos").collect()
    return n, [int(high) * LOW + int(low) for _, high, low in sums]


def _centred(n: int, sums: list[int]):
    """Rows minus the mean as doubles, and the exact sum of squares of n times that."""
    floor = [s // n for s in sums]
    rest = [s % n for s in sums]
    constant = sum(r * r for r in rest)

    def run(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa
        base, over = np.array(floor, np.int64), np.array(rest, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(2)) - base
            centred = y - over / n
            top = max(int(np.abs(y).max()), 1) * len(sums)
            if top * max(max(rest), int(np.abs(y).max())) < 1 << 62:
                squares, crossed = (y * y).sum(1).tolist(), (y * over).sum(1).tolist()
            else:  # beyond 64 bits: Python's integers
                squares = [sum(v * v for v in row) for row in y.tolist()]
                crossed = [sum(v * r for v, r in zip(row, rest)) for row in y.tolist()]
            exact = [n * n * a - 2 * n * b + constant for a, b in zip(squares, crossed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([Decimal(e) if e < 10 ** 38 else None for e in exact], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * len(sums), pa.array(centred.ravel()))],
                names=["index", "vec_id", "deviation", "centred"])
    return run


def _moments(shift: list[float], squares: bool):
    """Sums over the rows minus ``shift``: of the rows, or of their products."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        total = 0
        for batch in batches:
            if batch.num_rows:
                z = _matrix(batch.column(0)) - np.array(shift)
                total = total + (z.T @ z).ravel() if squares else total + z.sum(0)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])
    return run


def _moment(rows: DataFrame, shift: list[float], squares: bool) -> list[float]:
    """One row a partition, added up in Spark by place."""
    parts = rows.mapInArrow(_moments(shift, squares), "sums array<double>")
    return [r[1] for r in parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).orderBy("pos").collect()]


def _blocks(rows: DataFrame, start: int, end: int, dims: int, rows_per_block: int) -> BlockMatrix:
    part = rows.where(F.col("index").between(start, end - 1)).select(
        (F.col("index") - start).alias("index"), array_to_vector("centred").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(part, "vector"), end - start, dims).toBlockMatrix(
        rows_per_block, min(dims, 1024))


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``, the sum over the middle dimension dealt out to
    ``splits`` tasks for each block of the result."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _local(spark, matrix, rows_per_block: int, cols_per_block: int) -> BlockMatrix:
    """A small local matrix as a block matrix."""
    from pyspark.mllib.linalg import Vectors
    rows = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(matrix.tolist())], ["index", "vector"])
    return IndexedRowMatrix(rows, *matrix.shape).toBlockMatrix(rows_per_block, cols_per_block)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding",
           blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """One row per usable vector (see ``fit_list``; the others are left out): ``vec_id,
    n, deviation, whitened, explained, identity_error``.

    ``whitened`` (array of doubles) is the centred integer vector projected on the
    first ``components`` unit eigenvectors of the covariance (or on all, if it has
    fewer dimensions) and divided by the root of the eigenvalue; ``explained`` (array)
    the share of each eigenvalue in their sum; ``identity_error`` the largest absolute
    entry of the covariance of ``whitened``, computed from the rows, minus the
    identity; ``deviation`` decimal(38,0) the exact sum of ``(n * x - S)^2``, null from
    10^38 on.

    Directions without spread (one vector, equal vectors, fewer vectors than
    dimensions, constant entries) have ``whitened`` 0 and take no part in
    ``identity_error``; if there is no spread at all ``explained`` is 0. Repeated and
    null ids are rows like others. An empty table gives no rows; other columns are not
    read.
    """
    import numpy as np
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = fit_list(vectors, id_col, vec_col)
    n, sums = dimension_sums(rows)
    schema = f"index bigint, vec_id {kind}, deviation decimal(38,0), centred array<double>"
    if not n:
        none = F.array().cast("array<double>")
        return spark.createDataFrame([], schema).select(
            "vec_id", F.lit(0).cast("bigint").alias("n"), "deviation", none.alias("whitened"), none.alias("explained"),
            F.lit(0.0).alias("identity_error"))
    dims = len(sums)
    centred = written(rows.mapInArrow(_centred(n, sums), schema), "white-centred")
    end = centred.agg(F.max("index")).first()[0] + 1
    per_block = max(1, min(BLOCK_BYTES // (8 * min(dims, 1024)), 1 << 15))
    step = per_block * blocks_at_once
    parts = [(s, min(s + step, end)) for s in range(0, end, step)]
    blocks = [_blocks(centred, s, e, dims, per_block) for s, e in parts]

    scatter = np.zeros((dims, dims))
    for (s, e), m in zip(parts, blocks):
        count = -(-(e - s) // per_block)
        splits = max(-(-count // BLOCKS_TOGETHER), min(count, shuffle_partitions(spark)))
        scatter += _product(m.transpose(), m, splits).toLocalMatrix().toArray()
    values, units = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, units = values[::-1][:components], units[:, ::-1][:, :components]
    spread = values > max(values[0], 0.0) * NULL_SPACE
    matrix = np.where(spread, units / np.sqrt(np.where(spread, values, 1.0)), 0.0)
    trace = scatter.trace() / n
    explained = (values / trace).tolist() if trace > 0 else [0.0] * len(values)

    projected = None
    for (s, _), m in zip(parts, blocks):
        z = m.multiply(_local(spark, matrix, m.colsPerBlock, len(values))).toIndexedRowMatrix()
        z = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", z._java_matrix_wrapper._java_model), "vector")
        z = z.select((F.col("index") + s).alias("index"), vector_to_array("vector").alias("whitened"))
        projected = z if projected is None else projected.unionByName(z)
    out = written(centred.select("index", "vec_id", "deviation").join(projected, "index").drop("index"), "white-rows")
    mean = [m / n for m in _moment(out.select("whitened"), [0.0] * len(values), False)]
    covariance = np.array(_moment(out.select("whitened"), mean, True)).reshape(len(values), -1) / n
    error = np.abs(covariance - np.eye(len(values)))[np.ix_(spread, spread)]
    return out.select(
        "vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(e) for e in explained]).alias("explained"),
        F.lit(float(error.max()) if error.size else 0.0).alias("identity_error"))
