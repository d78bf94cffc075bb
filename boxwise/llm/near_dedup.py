"""Near-duplicates by DartMinHash sketches and banded joining.

1. One pass over the texts gives each a digest of its words, a sketch of its
   weighted five-word shingles and the hashes of the sketch's bands.
2. Texts with the same words are one node from there on, however many there are.
3. Nodes that share a band are candidates: in small buckets all pairs, in larger
   ones every node with the bucket's most connected node (a star, one pair per row).
4. Candidates whose sketches allow it are verified on their whole shingle sets;
   pairs of the wanted similarity are links, their components are the classes.
5. Large buckets whose nodes ended in several classes are searched again: every
   node outside the bucket's main class against all nodes of other classes, so
   that no pair the bands brought together is left out. That is done in blocks of
   bounded size, which return links only, one for each class that a node reaches.

Copies are never expanded to pairs, no bucket is collected into one task, and
links and classes stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from boxwise.llm.common import components, written
from boxwise.llm.dart_sketch import Shingler, bands, sketches

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4     # a pair of similarity 0.8 shares no band with a chance of 3e-6
SKETCHED_TOGETHER = 100  # texts whose darts are thrown in one go
SMALL_BUCKET = 8        # nodes up to which a bucket's pairs are all listed
BLOCK_SHINGLES = 500_000  # shingles on either side of a block that compares the rest of large buckets
SLACK = 0.18            # more than 4 standard errors of a 96-dart estimate at 0.8


def _sketches(words: int, n_bands: int, rows: int, weighted: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        shingle = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, SKETCHED_TOGETHER):
                part = batch.slice(start, SKETCHED_TOGETHER)
                digests, sets, counts = [], [], []
                for t in part.column(2):
                    own = (t.as_py() or "").lower().split()
                    digests.append(xxhash.xxh3_128_hexdigest(" ".join(own)))
                    elements, times = shingle(own)
                    sets.append(elements)
                    counts.append(times.astype(float))
                sizes = [float(c.sum() if weighted else len(c)) for c in counts]
                some = [i for i, x in enumerate(sets) if len(x)]
                full = sketches([sets[i] for i in some], n_bands * rows, [counts[i] for i in some] if weighted else None)
                hashes, signs = [None] * len(sets), [None] * len(sets)
                for i, sign in zip(some, full):
                    hashes[i] = bands(sign, rows)
                    signs[i] = (sign & np.uint64(0xFFFF)).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests), pa.array(sizes),
                     pa.array(hashes, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int16()))],
                    names=["doc_id", "tkey", "digest", "size", "bands", "sign"])
    return run


def _shingle_sets(words: int):
    """The whole weighted shingle set of each wanted text; rows that only share
    the id of a wanted text are dropped."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        shingle = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                nodes, sets, counts = [], [], []
                for node, digest, t in zip(part.column(0), part.column(1), part.column(2)):
                    own = (t.as_py() or "").lower().split()
                    if xxhash.xxh3_128_hexdigest(" ".join(own)) == digest.as_py():
                        elements, times = shingle(own)
                        nodes.append(node.as_py())
                        sets.append(elements.tobytes())
                        counts.append(times.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())],
                    names=["node", "elements", "times"])
    return run


def _similarities(weighted: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = []
            cols = [batch.column(i) for i in range(2, 6)]
            for x, xn, y, yn in zip(*cols):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                xn, yn = np.frombuffer(xn.as_py(), "<u4"), np.frombuffer(yn.as_py(), "<u4")
                out.append(_jaccard(x, xn, y, yn, weighted))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())],
                                             names=["a", "b", "similarity"])
    return run


def _jaccard(x, xn, y, yn, weighted: bool) -> float:
    import numpy as np
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not weighted:
        return len(both) / (len(x) + len(y) - len(both))
    same = float(np.minimum(xn[i], yn[j]).sum())
    return same / (float(xn.sum()) + float(yn.sum()) - same)


def _cross_links(similarity: float, weighted: bool):
    """Open nodes of a bucket against nodes of its other classes: sketches for all,
    whole sets for those that may do, and one link for each class reached. A pair
    that shares several bands is looked at in the first of them."""
    def run(key, some, every):
        import numpy as np
        import pandas as pd
        out = []
        if len(some) and len(every):
            band = int(key[0])
            signs, bands_ = np.stack(every["sign"].to_numpy()), np.stack(every["bands"].to_numpy())
            node, root, size = (every[c].to_numpy() for c in ("node", "root", "size"))
            inmain = ~every["open"].to_numpy()
            sets = [np.frombuffer(bytes(b), np.uint64) for b in every["elements"]]
            times = [np.frombuffer(bytes(b), "<u4") for b in every["times"]]
            for a, ra, sa, sign, own, x, xn in zip(*(some[c] for c in (
                    "node", "root", "size", "sign", "bands", "elements", "times"))):
                x, xn = np.frombuffer(bytes(x), np.uint64), np.frombuffer(bytes(xn), "<u4")
                near = (signs == np.asarray(sign)).mean(1)
                at = np.flatnonzero((near >= similarity - SLACK) & (root != ra) & (inmain | (node > a)) & (
                    np.minimum(size, sa) >= np.maximum(size, sa) * (similarity - 1e-9)))
                at = at[(bands_[at] == np.asarray(own)).argmax(1) == band] if len(at) else at
                reached = set()
                for t in at[np.argsort(-near[at], kind="stable")]:
                    if root[t] not in reached and _jaccard(x, xn, sets[t], times[t], weighted) >= similarity - 1e-12:
                        reached.add(root[t])
                        out.append((a, node[t]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


def agreement(a: str, b: str, coordinates: int) -> str:
    """SQL: the share of equal coordinates of two sketches."""
    return f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), z -> z)) / {coordinates}D"


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, n_bands: int = BANDS,
                           rows: int = ROWS, weighted: bool = False, small: int = SMALL_BUCKET,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, tkey, class_id, class_size, kept``.

    ``class_id`` is the least doc_id of the class, ``kept`` marks the one row of
    the class that stays (least doc_id, nulls last, then first read), ``tkey``
    the hash of the row's text. A class is a connected component of documents
    whose shingle sets have the given Jaccard similarity or more (``weighted``:
    with each shingle counted as often as it occurs). Texts shorter than a
    shingle are one shingle; texts without words, null ones included, are equal
    to each other only. An empty table gives no rows; other columns are not read.
    """
    coordinates = n_bands * rows
    kind = docs.schema[id_col].dataType.simpleString()
    sketched = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tkey"),
                           F.col(text_col).alias("text")).mapInArrow(
        _sketches(words, n_bands, rows, weighted),
        f"doc_id {kind}, tkey bigint, digest string, size double, bands array<bigint>, sign array<smallint>")
    rows_ = written(sketched.select(F.monotonically_increasing_id().alias("uid"), "*"), "near-sketches")
    firsts = rows_.groupBy("digest").agg(F.min("uid").alias("node"))
    of = written(rows_.select("uid", "doc_id", "tkey", "digest").join(firsts, "digest").select(
        "uid", "doc_id", "tkey", "node"), "near-nodes")
    nodes = rows_.where("bands IS NOT NULL").join(
        firsts.select(F.col("node").alias("uid")), "uid", "left_semi").withColumnRenamed("uid", "node")
    member = written(nodes.select("node", "size", F.posexplode("bands").alias("band", "value")), "near-buckets")
    counts = member.groupBy("band", "value").agg(F.count("*").alias("m")).where("m > 1")
    shared = written(member.join(counts, ["band", "value"]), "near-shared")

    # candidates: all pairs of small buckets, stars of larger ones
    few = shared.where(F.col("m") <= small).groupBy("band", "value").agg(
        F.sort_array(F.collect_list("node")).alias("own"))  # at most `small` nodes each
    pairs = few.select(F.explode("own").alias("a"), "own").select("a", F.explode("own").alias("b")).where("a < b")
    # a star's hub is the node that shares most bands with most others: the text
    # that the others vary, if it is there, and the same one in all its buckets
    large = shared.where(F.col("m") > small)
    weight = large.groupBy("node").agg(F.sum("m").alias("weight"))
    hubs = large.join(weight, "node").groupBy("band", "value").agg(
        F.max(F.struct("weight", F.negative("node").alias("order"))).alias("best")).select(
        "band", "value", F.negative("best.order").alias("hub"))
    stars = large.join(hubs, ["band", "value"]).where("node <> hub").select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    tried = written(pairs.union(stars).distinct(), "near-tried")
    sign = nodes.select("node", "size", "sign", "digest", "doc_id", "tkey")

    def shingle_sets(wanted: DataFrame, name: str) -> DataFrame:
        """(node, elements, times) of some nodes, from their texts."""
        wanted = sign.select("node", "digest", "doc_id", "tkey").join(wanted, "node").withColumnRenamed("doc_id", "__id__")
        texts = docs.select(F.col(id_col).alias("__doc__"), F.xxhash64(F.col(text_col)).alias("__key__"),
                            F.col(text_col).alias("text"))
        return written(texts.join(wanted, F.col("__doc__").eqNullSafe(F.col("__id__")) & (F.col("__key__") == F.col("tkey"))).select(
            "node", "digest", "text").mapInArrow(
            _shingle_sets(words), "node bigint, elements binary, times binary").dropDuplicates(["node"]), f"near-sets-{name}")

    def linked(candidates: DataFrame, name: str) -> DataFrame:
        """The candidates (a, b) that have the wanted similarity."""
        one = sign.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("sign").alias("ga"))
        two = sign.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("sign").alias("gb"))
        able = written(candidates.join(one, "a").join(two, "b").where(
            (F.least("sa", "sb") >= F.greatest("sa", "sb") * (similarity - 1e-9)) &
            (F.expr(agreement("ga", "gb", coordinates)) >= similarity - SLACK)).select("a", "b"), f"near-able-{name}")
        sets = shingle_sets(able.select(F.col("a").alias("node")).union(able.select("b")).distinct(), name)
        x = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"), F.col("times").alias("xn"))
        y = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"), F.col("times").alias("yn"))
        verified = able.join(x, "a").join(y, "b").select("a", "b", "x", "xn", "y", "yn").mapInArrow(
            _similarities(weighted), "a bigint, b bigint, similarity double")
        return written(verified.where(F.col("similarity") >= similarity - 1e-12).select("a", "b"), f"near-links-{name}")

    links = linked(tried, "0")
    label = components(links, "near0")
    # large buckets with several classes left: the pairs that the stars did not see
    placed = written(large.join(label, "node", "left").select(
        "band", "value", "node", "size", F.coalesce("root", "node").alias("root")), "near-placed")
    per_class = placed.groupBy("band", "value", "root").agg(F.count("*").alias("n"))
    mixed = written(per_class.groupBy("band", "value").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("classes")).where(
        "classes > 1").drop("classes"), "near-mixed")
    if not mixed.isEmpty():
        inside = placed.join(mixed, ["band", "value"])
        sets = shingle_sets(inside.select("node").distinct(), "1")
        inside = written(inside.withColumn("open", F.col("root") != F.col("main")), "near-inside")
        parts = inside.groupBy("band", "value").agg(
            F.ceil(F.sum(F.when(F.col("open"), F.col("size"))) / BLOCK_SHINGLES).cast("int").alias("rows"),
            F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("cols"))
        inside = inside.join(parts, ["band", "value"]).join(nodes.select("node", "sign", "bands"), "node").join(sets, "node")
        part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        some = inside.where("open").select("*", part("rows").alias("row"), F.explode(
            F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
        every = inside.select("*", part("cols").alias("col"), F.explode(
            F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
        every = every.select(*[F.col(c).alias(c) for c in every.columns])  # columns of its own for the cogroup
        keys = ["band", "value", "row", "col"]
        more = some.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(
            _cross_links(similarity, weighted), "a bigint, b bigint")
        more = written(more, "near-more")
        if not more.isEmpty():
            links = written(links.union(more), "near-links")
            label = components(links, "near1")

    out = of.join(label, "node", "left").select("uid", "doc_id", "tkey", F.coalesce("root", "node").alias("root"))
    classes = out.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best"))
    return out.join(classes, "root").select(
        "doc_id", "tkey", "class_id", "class_size", (F.col("uid") == F.col("best.uid")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of near-duplicates, with all columns of ``docs``."""
    classes = written(near_duplicate_classes(docs, id_col=id_col, text_col=text_col, **options), "near-decided")
    kept = classes.where("kept").select(F.col("doc_id").alias("__id__"), F.col("tkey").alias("__key__"))
    key = F.xxhash64(F.col(text_col))
    out = docs.join(kept, F.col(id_col).eqNullSafe(F.col("__id__")) & (key == F.col("__key__")), "left_semi")
    twice = classes.groupBy("doc_id", "tkey").agg(F.count("*").alias("n"), F.max("kept").alias("k")).where("n > 1 and k")
    if twice.isEmpty():
        return out
    return out.withColumn("__key__", key).dropDuplicates([id_col, "__key__"]).drop("__key__")
