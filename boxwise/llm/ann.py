"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is split into balanced clusters, whose centroids the driver
holds with a graph of their nearest neighbours. Every vector is written to the
posting list of its nearest centroid and, if it lies near a boundary, to further
lists almost as near. A query finds its nearest centroids by a walk over the
graph, keeps those within a ratio of the nearest one's distance, and is compared
with every vector of their lists in double precision. How many lists and which
ratio is measured in each run, on some queries compared with all vectors. Lists that outgrow a task
are dealt out in parts, so a vector that a third of all rows share is no
bottleneck.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from boxwise.llm.common import written

SAMPLE = 20_000        # vectors that the centroids are fitted on, at most
LIST_ROWS = 160        # rows of a posting list that the number of lists aims at
MAX_LISTS = 4_096      # centroids in memory, at most
REPLICAS, REPLICA_RATIO = 6, 1.06
PROBES, PROBE_RATIO = 128, 1.2  # at least; more where these miss RECALL
RECALL, TRIALS = 0.95, 200      # recall wanted, and queries that it is measured on
DEGREE, BEAM = 24, 32   # of the graph, and of a walk over it at least
PART_ROWS, PART_QUERIES = 4_000, 2_000
SEED = 17


@dataclass
class Centroids:
    """The centroids and, for each, its nearest ones and links to far ones."""
    points: np.ndarray
    graph: np.ndarray

    def search(self, vectors: np.ndarray, wanted: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, distances) of about the ``wanted`` nearest centroids of each
        vector, nearest first: best-first walks over the graph, all at once."""
        count, total = len(vectors), len(self.points)
        wanted, beam = min(wanted, total), min(max(beam, wanted), total)
        square = (self.points ** 2).sum(1)
        dist = np.full((count, total), np.inf)
        open_ = np.zeros((count, total), bool)
        rows = np.arange(count)

        def visit(r: np.ndarray, c: np.ndarray):
            new = np.isinf(dist[r, c])
            r, c = r[new], c[new]
            d = square[c] - 2.0 * np.einsum("ij,ij->i", vectors[r], self.points[c])
            dist[r, c], open_[r, c] = d, True

        entries = np.unique(np.linspace(0, total - 1, min(total, 16)).astype(int))
        visit(np.repeat(rows, len(entries)), np.tile(entries, count))
        active = rows
        while len(active):
            own = np.where(open_[active], dist[active], np.inf)
            nearest = own.argmin(1)
            bound = np.partition(dist[active], beam - 1, axis=1)[:, beam - 1]
            go = own[np.arange(len(active)), nearest] <= bound
            go &= np.isfinite(own[np.arange(len(active)), nearest])
            active, nearest = active[go], nearest[go]
            open_[active, nearest] = False
            visit(np.repeat(active, self.graph.shape[1]), self.graph[nearest].ravel())
        best = np.argsort(dist, axis=1, kind="stable")[:, :wanted]
        near = np.take_along_axis(dist, best, 1) + (vectors ** 2).sum(1)[:, None]
        return best, np.sqrt(np.maximum(near, 0))


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Cluster numbers; a cluster's size makes it dearer, which keeps sizes even."""
    centers = points[rng.choice(len(points), k, replace=False)]
    spread = float(points.var(axis=0).sum())
    sizes, own = np.full(k, len(points) / k), np.zeros(len(points), int)
    for _ in range(rounds):
        cost = (centers ** 2).sum(1) - 2 * points @ centers.T + 0.5 * spread * (sizes * k / len(points) - 1)
        own = cost.argmin(1)
        sizes = (sizes + np.bincount(own, minlength=k)) / 2
        for c in range(k):
            if (own == c).any():
                centers[c] = points[own == c].mean(0)
    return own


def fit_centroids(sample: np.ndarray, lists: int, seed: int = SEED) -> Centroids:
    """Splits the distinct sample vectors into clusters of at most an even share
    until there are about ``lists``."""
    rng = np.random.default_rng(seed)
    points = np.unique(sample, axis=0)
    most = max(1, math.ceil(len(points) / lists))
    todo, centers = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= most:
            centers.append(points[own].mean(0))
            continue
        k = min(8, math.ceil(len(own) / most), len(own))
        part = _kmeans(points[own], max(2, k), rng)
        groups = [own[part == c] for c in np.unique(part)]
        if len(groups) == 1:
            groups = np.array_split(own, 2)
        todo += groups
    centers = np.array(centers)
    square = (centers ** 2).sum(1)
    degree = min(DEGREE, len(centers))
    graph = np.empty((len(centers), degree + 4), int)
    for at in range(0, len(centers), 512):
        d = square - 2 * centers[at:at + 512] @ centers.T
        graph[at:at + 512, :degree] = np.argsort(d, axis=1, kind="stable")[:, :degree]
    graph[:, degree:] = rng.integers(0, len(centers), (len(centers), 4))
    return Centroids(centers, graph)


# --- Spark -------------------------------------------------------------------

def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part: not null, not zero, no
    null or non-finite component, and of the commonest dimension (the smaller one
    of equally common ones)."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("embedding"), F.size(v).alias("dim")).where(
        F.col("vec_id").isNotNull() & (F.col("dim") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    return rows.join(F.broadcast(common.select("dim")), "dim", "left_semi")  # one row


def _matrix(column) -> np.ndarray:
    values = np.array(column.flatten(), dtype=np.float64)
    return values.reshape(len(column), -1)


def _routed(shared, wanted: int, ratio: float, sizes: np.ndarray | None = None, least: int = 0):
    """Rows (vec_id, embedding) -> (vec_id, embedding, list) for every list they go
    to: those within the ratio, and the nearest ones until they hold ``least`` rows."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        index = Centroids(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                best, dist = index.search(_matrix(part.column(1)), wanted)
                keep = dist <= dist[:, :1] * ratio if math.isfinite(ratio) else np.ones(dist.shape, bool)
                if sizes is not None:
                    keep |= np.cumsum(sizes[best], axis=1) - sizes[best] < least
                row, col = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array(best[row, col].astype(np.int32))], names=["vec_id", "embedding", "list"])
    return run


def _compared(k: int):
    """One part of a list against the queries routed to it -> the k nearest of each."""
    def run(key, queries, rows):
        import pandas as pd
        out = []
        if len(queries) and len(rows):
            ids = rows["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, points = ids[order], np.stack(rows["embedding"].to_numpy())[order]
            asked, vectors = queries["query_id"].to_numpy(), np.stack(queries["embedding"].to_numpy())
            square = (points ** 2).sum(1)
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for at in range(0, len(asked), 256):
                near = square - 2 * vectors[at:at + 256] @ points.T + (vectors[at:at + 256] ** 2).sum(1)[:, None]
                if len(starts) > k + 1:
                    # rows of one id are one candidate
                    own = near if len(starts) == len(ids) else np.minimum.reduceat(near, starts, axis=1)
                    bound = np.partition(own, k, axis=1)[:, k]
                else:
                    bound = np.full(len(near), np.inf)
                for i, (q, v) in enumerate(zip(asked[at:at + 256], vectors[at:at + 256])):
                    # rounding moves `near` by far less than this margin
                    found = np.flatnonzero((near[i] <= bound[i] + 1e-9 * (1 + square + (v ** 2).sum())) & (ids != q))
                    exact = np.sqrt(((points[found] - v) ** 2).sum(1))
                    top = np.argsort(exact, kind="stable")
                    top = top[np.sort(np.unique(ids[found[top]], return_index=True)[1])[:k]]
                    out += [(q, ids[found[t]], exact[t]) for t in top]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def _trials(ids: np.ndarray, vectors: np.ndarray, k: int):
    """Rows (vec_id, embedding) -> the k nearest ids of a task's rows to each trial query."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        best: list[dict[int, float]] = [{} for _ in ids]
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                own, points = np.array(part.column(0)), _matrix(part.column(1))
                near = (points ** 2).sum(1) - 2 * vectors @ points.T
                for i, q in enumerate(ids):
                    held = best[i]
                    bound = max(held.values()) if len(held) >= k else math.inf
                    at = np.flatnonzero((near[i] < bound) & (own != q))
                    for j in at[np.argsort(near[i, at], kind="stable")]:
                        if len(held) >= k and near[i, j] >= bound:
                            break
                        held[int(own[j])] = min(float(near[i, j]), held.get(int(own[j]), math.inf))
                        if len(held) > k:
                            del held[max(held, key=held.get)]
                        bound = max(held.values()) if len(held) >= k else math.inf
        rows = [(int(q), v, s) for q, held in zip(ids, best) for v, s in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                                         names=["query_id", "vec_id", "score"])
    return run


def calibrated(plain: DataFrame, postings: DataFrame, asked: DataFrame, index: Centroids, sizes: np.ndarray, k: int,
               probes: int, ratio: float) -> tuple[int, float]:
    """The probes and ratio, at least the given ones, that read the fewest rows
    among those that find RECALL of the true neighbours of some queries."""
    trial = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).toPandas()  # at most TRIALS rows
    if not len(trial):
        return probes, ratio
    ids, vectors = trial["vec_id"].to_numpy(), np.stack(trial["embedding"].to_numpy())
    near = plain.mapInArrow(_trials(ids, vectors, k), "query_id bigint, vec_id bigint, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    true = F.broadcast(near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id"))  # TRIALS * k rows
    place = {int(q): i for i, q in enumerate(ids)}
    # the lists of each true neighbour
    lists: dict[tuple[int, int], list[int]] = {}
    for r in postings.select("vec_id", "list").join(true, "vec_id").distinct().collect():
        lists.setdefault((place[r["query_id"]], r["vec_id"]), []).append(r["list"])
    best, rows = None, 0.0
    while True:
        order, dist = index.search(vectors, probes)
        for r in (ratio, *(x for x in (1.25, 1.3, 1.4, 1.5, 2.0) if x > ratio), math.inf):
            keep = dist <= dist[:, :1] * r if math.isfinite(r) else np.ones(dist.shape, bool)
            keep |= np.cumsum(sizes[order], axis=1) - sizes[order] < (k + 1) * REPLICAS
            read = np.zeros((len(ids), len(sizes)), bool)
            np.put_along_axis(read, order, keep, 1)
            hit = sum(bool(read[q, own].any()) for (q, _), own in lists.items())
            cost = float((sizes * read).sum())
            if hit >= RECALL * len(lists) and (best is None or cost < rows):
                best, rows = (probes, r), cost
        if probes >= len(sizes):
            return best or (probes, math.inf)
        probes = min(len(sizes), probes * 2)


def nearest_neighbours(vectors: DataFrame, queries_every: int = 100, k: int = 10, sample: int = SAMPLE,
                       list_rows: int = LIST_ROWS, probes: int = PROBES, probe_ratio: float = PROBE_RATIO,
                       id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors found for every query (ids divisible by
    ``queries_every``): ``query_id, rank, vec_id, score``, the score being the
    Euclidean distance of the original vectors in double precision; ties go to
    the smaller id, and a query is no answer to itself. All vectors are indexed;
    only the centroids come from a sample. Ids that occur on several rows count
    as one candidate, at its least distance, and as one query each, at its first
    vector by value. ``probes`` and ``probe_ratio`` are the least; they grow until
    RECALL of the true neighbours is found. A query whose lists hold fewer than k candidates is searched
    again in more lists, at last in all, so fewer rows come only if the table has
    fewer candidates; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col), "ann-vectors")
    n = rows.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample / n)
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").toPandas()
    if not len(picked):
        picked = rows.select("embedding").limit(1).toPandas()
    lists = int(min(MAX_LISTS, max(1, n // list_rows), max(1, len(picked) // 8)))
    centroids = fit_centroids(np.stack(picked["embedding"].to_numpy()), lists)
    shared = spark.sparkContext.broadcast((centroids.points, centroids.graph))  # at most MAX_LISTS rows
    kind = "vec_id bigint, embedding array<double>, list int"
    plain = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    postings = written(plain.mapInArrow(_routed(shared, REPLICAS, REPLICA_RATIO), kind), "ann-postings")
    asked = plain.where(F.col("vec_id") % queries_every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # rows of each list: at most MAX_LISTS rows
    counts = written(postings.groupBy("list").agg(F.count("*").alias("n")), "ann-sizes")
    sizes = np.zeros(len(centroids.points), np.int64)
    for r in counts.collect():
        sizes[r["list"]] = r["n"]

    def searched(queries: DataFrame, probes: int, ratio: float) -> DataFrame:
        """query_id, rank, vec_id, score of the nearest in the lists of each query."""
        # a vector stands in REPLICAS lists at most, and the query itself is no answer
        routed = written(queries.mapInArrow(_routed(shared, probes, ratio, sizes, (k + 1) * REPLICAS), kind), "ann-routed")
        # parts of each list, and parts of its queries: one row per list
        parts = counts.select("list", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
        turns = routed.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("turns"))
        plan = F.broadcast(written(parts.join(turns, "list"), "ann-lists"))  # at most MAX_LISTS rows
        left = routed.join(plan, "list").select(
            F.col("vec_id").alias("query_id"), "embedding", "list",
            F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int").alias("turn"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = postings.join(plan, "list").select(
            "vec_id", "embedding", "list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"),
            F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
        keys = ["list", "part", "turn"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            _compared(k), "query_id bigint, vec_id bigint, score double")
        # a vector of several lists counts once
        once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
        return written(once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-found")

    asked = written(asked, "ann-asked")
    probes, probe_ratio = calibrated(plain, postings, asked, centroids, sizes, k, probes, probe_ratio)
    found = searched(asked, probes, probe_ratio)
    wanted = min(k, plain.select("vec_id").distinct().count() - 1)
    while probes < len(sizes):
        full = found.where(F.col("rank") == wanted).select("query_id")
        short = asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti") if wanted else asked.limit(0)
        short = written(short, "ann-short")
        if short.isEmpty():
            break
        probes *= 4
        found = found.join(full, "query_id", "left_semi").select(found.columns).unionByName(searched(short, probes, math.inf))
    return found
