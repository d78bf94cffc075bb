"""Mixing overlapping sources to target weights by min-cost flow.

Documents are counted by membership pattern (the set of sources a document
belongs to). A flow routes word capacity from the patterns to the source quotas:
each pattern offers its words once at cost 1, again at cost 2, and so on up to
the greatest repetition, so that the marginal cost rises (convex) and a second
copy is taken only where first copies do not suffice. The network has one node
per pattern and per source, whose number does not grow with the documents and is
checked. What a pattern gives is then made up of whole copies and, in seeded
order, of single documents up to the last word.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boxwise.llm.common import text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
MAX_NODES = 20_000  # patterns and sources that the driver's network may have
BUCKET_BITS = 12    # a pattern's seeded order is cut into 2^12 steps, one of which is looked at row by row


def word_count(c: Column) -> Column:
    """Runs of anything but ASCII white space."""
    squeezed = F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", 0).otherwise(
        F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("bigint")


# --- quotas and flow, on a few numbers per source ----------------------------

def capped_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the
    excess shared out again by weight until none is above."""
    out = [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        if weight <= 0:
            break
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


class Flow:
    """Successive cheapest paths with potentials."""

    def __init__(self):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.at: dict[int, list[int]] = defaultdict(list)

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        self.at[a].append(len(self.to))
        self.at[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        high: dict[int, int] = defaultdict(int)
        while True:
            dist, via, queue = {source: 0}, {}, [(0, source)]
            while queue:
                d, u = heappop(queue)
                if d > dist[u]:
                    continue
                for e in self.at[u]:
                    v = self.to[e]
                    if self.room[e] > 0:
                        n = d + self.cost[e] + high[u] - high[v]
                        if n < dist.get(v, 1 << 62):
                            dist[v], via[v] = n, e
                            heappush(queue, (n, v))
            if sink not in dist:
                return
            for v, d in dist.items():
                high[v] += d
            far = max(dist.values())
            for v in list(self.at):
                if v not in dist:
                    high[v] += far
            v, most = sink, 1 << 62
            while v != source:
                most = min(most, self.room[via[v]])
                v = self.to[via[v] ^ 1]
            v = sink
            while v != source:
                self.room[via[v]] -= most
                self.room[via[v] ^ 1] += most
                v = self.to[via[v] ^ 1]


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[int]:
    """Words that each pattern (its sources, its size) gives, in all.

    The cost of a pattern's k-th copy is k, so total repetition is least; quotas
    beyond all capacity stay partly unfilled."""
    net = Flow()
    n = len(patterns)
    gives = []
    for p, (members, size) in enumerate(patterns):
        gives.append([net.edge(0, 1 + p, size, copy) for copy in range(1, repeats + 1)])
        for s in members:
            net.edge(1 + p, 1 + n + s, 1 << 62, 0)
    sink = 1 + n + len(quotas)
    for s, quota in enumerate(quotas):
        net.edge(1 + n + s, sink, quota, 0)
    net.run(0, sink)
    return [sum(net.room[e ^ 1] for e in own) for own in gives]


# --- selection ---------------------------------------------------------------

def plan_mix(counted: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """Per pattern: ``pattern, pattern_size, give``; per first source: its target.

    ``counted`` has (members array<string>, size). Source and pattern totals are
    the only rows that reach the driver; their number is checked."""
    spark = counted.sparkSession
    totals = counted.groupBy(F.col("members").alias("pattern")).agg(
        F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_NODES + 1).collect()
    if len(totals) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} membership patterns: the flow is not meant for them")
    order = lambda s: (s is None, "" if s is None else s)  # noqa: E731  code points, null last
    sources = sorted({s for r in totals for s in r.pattern}, key=order)
    number = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for r in totals:
        for s in set(r.pattern):
            sizes[number[s]] += r["size"]
    weight = [float(weights[i % len(weights)]) for i in range(len(sources))]
    target = capped_targets(sizes, weight, share * sum(r["size"] for r in totals), most)
    patterns = [(tuple(sorted({number[s] for s in r.pattern})), int(r["size"])) for r in totals]
    give = route(patterns, [round(t) for t in target], most)
    rows = [(list(r.pattern), int(r["size"]), int(g), [int(sizes[number[s]]) for s in r.pattern],
             [float(target[number[s]]) for s in r.pattern]) for r, g in zip(totals, give)]
    return spark.createDataFrame(
        rows, "pattern array<string>, pattern_size long, give long, source_sizes array<long>, targets array<double>")


def _decided(docs: DataFrame, members: Column, weights: tuple[float, ...], share: float, most: int, seed: int,
             id_col: str, text_col: str, whole: bool) -> DataFrame:
    counted = written(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
        F.array_sort(F.array_distinct(members)).cast("array<string>").alias("members"),
        word_count(text_or_empty(text_col)).alias("size"),
        _draw(seed, id_col, text_col).alias("draw")), "mix-counted")
    plan = F.broadcast(plan_mix(counted, weights, share, most).withColumn(
        "rounds", F.when(F.col("pattern_size") > 0, F.floor(F.col("give") / F.col("pattern_size"))).otherwise(0)
    ).withColumn("rest", F.col("give") - F.col("rounds") * F.col("pattern_size")))  # at most MAX_NODES rows
    rows = counted.join(plan, F.col("members") == F.col("pattern")).withColumn(
        "bucket", F.shiftright("draw", 64 - BUCKET_BITS))
    # words before each step of a pattern's order, one row per step; the step in
    # which the rest is used up is looked at row by row
    before = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    steps = rows.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("words")).withColumn(
        "before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut = steps.where("before + words > rest").groupBy(F.col("pattern").alias("cut_pattern")).agg(
        F.min(F.struct("bucket", "before")).alias("cut"))
    rows = rows.join(F.broadcast(cut), F.col("pattern") == F.col("cut_pattern"), "left").drop("cut_pattern")
    at = F.col("cut.bucket")
    outside = rows.where((F.col("bucket") != at) | at.isNull()).withColumn(
        "extra", F.when(at.isNull() | (F.col("bucket") < at), F.col("size")).otherwise(0))
    inside = W.partitionBy("pattern").orderBy("draw", "doc_id", "uid").rowsBetween(W.unboundedPreceding, -1)
    within = rows.where(F.col("bucket") == at).withColumn(
        "missing", F.col("rest") - F.col("cut.before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    if whole:
        extra = F.when((F.col("missing") > 0) & (F.col("missing") * 2 >= F.col("size")), F.col("size")).otherwise(0)
    else:
        extra = F.least(F.greatest(F.col("missing"), F.lit(0)), F.col("size"))
    return outside.unionByName(within.withColumn("extra", extra).drop("missing"))


def _draw(seed: int, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), text_or_empty(text_col))


def mix(docs: DataFrame, members: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
        most: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, members, size, source_sizes, targets, taken``.

    ``members`` is the array of sources of a document, by default its ``source``
    alone (null is a source of its own, last in order); ``source_sizes`` and
    ``targets`` follow the order of ``members``. ``share`` times all words are
    shared out by ``weights`` repeating over the sources in code-point order; no
    document gives more than ``most`` times its words.

    A pattern that gives q whole rounds of its words and a rest takes every
    document q times, and once more in the order of a seeded hash until the rest
    is filled: the last document gives only the words still missing. Empty and
    null texts have size 0 and give nothing; repeated rows count as rows of their
    own; an empty table gives no rows.
    """
    if members is None:
        members = F.array(F.col("source"))
    return _decided(docs, members, weights, share, most, seed, id_col, text_col, False).select(
        "doc_id", "members", "size", "source_sizes", "targets",
        (F.col("rounds") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
                    share: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the
    columns of ``docs``. Documents are taken whole: the one in which a pattern's
    rest ends is in if that comes nearer, and rows of equal id and text are taken
    alike. Documents without a word are not in the mix."""
    rows = _decided(docs, F.array(F.col(source_col)), weights, share, most, seed, id_col, text_col, True)
    last = rows.groupBy("pattern", "rounds").agg(F.max(F.when(F.col("extra") > 0, F.col("draw"))).alias("last"))
    last = F.broadcast(written(last.select(
        F.col("pattern")[0].alias("__source__"), F.col("rounds").alias("__rounds__"),
        F.col("last").alias("__last__")), "mix-cuts"))  # one row per source
    names = docs.columns
    out = docs.join(last, F.col(source_col).cast("string").eqNullSafe(F.col("__source__")))
    copies = F.col("__rounds__") + F.when(_draw(seed, id_col, text_col) <= F.col("__last__"), 1).otherwise(0)
    copies = F.when(word_count(text_or_empty(text_col)) > 0, copies).otherwise(0)
    return out.withColumn("__copy__", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*names)
