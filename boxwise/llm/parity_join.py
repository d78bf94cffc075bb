"""N-gram Jaccard join by parity sketches.

1. One pass over the texts gives each the set of its hashed word shingles. Equal sets
   are one node from there on, however many documents have them.
2. Sizes are cut into bands by a factor of 4. A node joins in its own band and, as a
   guest, in larger ones that hold sizes similar enough to its own. In a band the
   shingles fall on ``k`` chunks of a very wide bit sketch, each flipping one bit, so
   that a shingle that only one of two sets has changes at most one chunk. Two sets
   of the wanted similarity differ in no more shingles than ``budget`` allows, hence
   agree in at least ``k - budget`` chunks: if each node keeps the first
   ``budget + 1`` of its chunks, in an order that all nodes share, the two have a kept
   chunk in common. Chunks of many shingles come first, which are the rare ones.
3. Kept chunks are sorted once, range-partitioned by chunk and node, so that a chunk
   of any number of nodes spreads over partitions; lone ones go there.
4. Nodes that share a chunk are candidates: all pairs of small chunks, in larger ones
   every node with the chunk's best connected one. Candidates pass if the Hamming
   distance of dense parity sketches, which is at most the symmetric difference, is
   within the bound; they are verified on whole shingle sets.
5. Chunks whose nodes ended in several components are compared in blocks of bounded
   size: first each node's closest partner in every other component, then, for what
   is still apart, every pair that the sketches allow. So no link between components
   is lost, and copies are never expanded to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from boxwise.llm.common import components, written
from boxwise.llm.dart_sketch import GOLDEN, MIX1, MIX2, Shingler, U, mixed

WORDS, PERCENT = 5, 80
FACTOR = 4           # of the sizes of a band
CACHED = 200_000     # words whose hashes a task keeps
SPARE = 1.35         # chunks per unit of the largest budget of a band
SMALL_CHUNK = 8      # nodes up to which all pairs are listed
BLOCK_ROWS, BLOCK_COLS = 1_000, 4_000  # nodes of a block of sketches
BLOCK_BYTES = 16 << 20  # of sketches compared in one go
TOGETHER = 256       # pairs of one node that share a copy of its payload


def most_different(together: int, percent: int) -> int:
    """The largest symmetric difference of two sets of ``together`` elements in all
    that have the similarity."""
    return together * (100 - percent) // (100 + percent)


def band_of(size: int) -> int:
    band = 0
    while size >= FACTOR ** (band + 1):
        band += 1
    return band


def bands_of(size: int, percent: int) -> range:
    """The band of a size and those of the larger sizes it may be similar to."""
    return range(band_of(size), band_of(size * 100 // percent) + 1)


def kept_chunks(elements, band: int, percent: int):
    """Hashes of the kept chunks of a set in a band."""
    import numpy as np
    largest = FACTOR ** (band + 1) - 1
    k = int(most_different(2 * largest, percent) * SPARE) + 2
    budget = most_different(len(elements) + min(largest, len(elements) * 100 // percent), percent)
    chunk = (((elements >> U(32)) * U(k)) >> U(32)).astype(np.int64)
    order = np.argsort(chunk, kind="stable")
    own, starts, times = np.unique(chunk[order], return_index=True, return_counts=True)
    # a bit of a chunk is hashed and bits are added by xor: bits that two shingles share cancel
    bits = mixed((elements[order] & U(0xFFFFFFFF)) + GOLDEN)
    value, count = np.zeros(k, U), np.zeros(k, np.int64)
    value[own], count[own] = np.bitwise_xor.reduceat(bits, starts), times
    name = mixed(value ^ mixed(np.arange(k).astype(U) * GOLDEN + count.astype(U) * MIX1 + np.array([band], U) * MIX2))
    return name[np.lexsort((name, -count))[:budget + 1]]


def dense_sketch(elements, band: int) -> bytes:
    """The parity of the shingles on each of about as many bits as the band's sizes."""
    import numpy as np
    bits = max(64, FACTOR ** (band + 1))
    at = (mixed(elements ^ MIX2) % U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _words(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return (text or b"").lower().split()


def _sketches(words: int, percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        shingle = Shingler(words, cache=CACHED)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                at, out = [], []
                for i, t in enumerate(part.column(3)):
                    elements, _ = shingle(_words(t.as_py()))
                    if not len(elements):
                        at.append(i)
                        out.append((None, 0, -1, None, None))
                        continue
                    digest = xxhash.xxh3_128_hexdigest(elements.tobytes())
                    for band in bands_of(len(elements), percent):
                        at.append(i)
                        out.append((digest, len(elements), band, dense_sketch(elements, band),
                                    kept_chunks(elements, band, percent).tobytes()))
                rows = part.select(["uid", "doc_id", "tkey"]).take(pa.array(at, pa.int64()))
                digests, sizes, bands, dense, chunks = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()),
                     pa.array(bands, pa.int32()), pa.array([b == -1 or b == band_of(n) for b, n in zip(bands, sizes)]),
                     pa.array(dense, pa.binary()), pa.array(chunks, pa.binary())],
                    names=["uid", "doc_id", "tkey", "digest", "size", "band", "own", "dense", "chunks"])
    return run


def _chunk_rows(batches: Iterator) -> Iterator:
    """One row for each kept chunk of a node."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            chunks = [np.frombuffer(c.as_py(), np.int64) for c in part.column(3)]
            rows = part.select(["node", "band", "own"]).take(pa.array(np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(chunks)), rows.column(0), rows.column(1), rows.column(2)],
                names=["chunk", "node", "band", "own"])


def _not_alone(batches: Iterator) -> Iterator:
    """Of rows sorted by chunk those whose chunk a neighbour has, and the chunks at
    either end of the partition, which may go on in the next one."""
    import numpy as np
    import pyarrow as pa
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        chunk = rows.column(0).to_numpy(zero_copy_only=False)
        same = chunk[1:] == chunk[:-1]
        # the last row waits for its successor; a row already known as shared keeps its mark
        keep = np.r_[first or held_shared, same] | np.r_[same, False]
        held, held_shared, first = rows.slice(len(chunk) - 1), bool(keep[-1]), False
        yield rows.slice(0, len(chunk) - 1).filter(pa.array(keep[:-1]))
    if held is not None:
        yield held


def _elements(words: int):
    """The whole shingle set of each wanted text; rows that only share the id and the
    hash of a wanted text are dropped."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        shingle = Shingler(words, cache=CACHED)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                nodes, sets = [], []
                for node, digest, t in zip(part.column(0), part.column(1), part.column(2)):
                    raw = shingle(_words(t.as_py()))[0].tobytes()
                    if xxhash.xxh3_128_hexdigest(raw) == digest.as_py():
                        nodes.append(node.as_py())
                        sets.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "payload"])
    return run


def _passing(test):
    """The pairs (a, b, x, y) whose payloads pass."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            keep = [test(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _near_enough(percent: int):
    """Sizes (first 8 bytes) and sketches that allow the similarity."""
    def test(x: bytes, y: bytes) -> bool:
        import numpy as np
        m, n = int.from_bytes(x[:8], "big"), int.from_bytes(y[:8], "big")
        if 100 * min(m, n) < percent * max(m, n):
            return False
        apart = np.bitwise_count(np.frombuffer(x, np.uint64, offset=8) ^ np.frombuffer(y, np.uint64, offset=8)).sum()
        return int(apart) <= most_different(m + n, percent)
    return test


def _similar(percent: int):
    def test(x: bytes, y: bytes) -> bool:
        import numpy as np
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        same = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * same >= percent * (len(x) + len(y) - same)
    return test


def _apart(percent: int, closest: bool):
    """Pairs of nodes of different components in a block that the sketches allow: all,
    or for every node the closest one of each other component (``again``: there are
    more)."""
    def run(key, some, every):
        import numpy as np
        import pandas as pd
        out = []
        if len(some) and len(every):
            ours, theirs = (np.stack([np.frombuffer(bytes(d), np.uint64) for d in t["dense"]]) for t in (some, every))
            mine, yours = ({c: t[c].to_numpy() for c in ("node", "root", "size", "own", "inmain")} for t in (some, every))
            step = max(1, BLOCK_BYTES // theirs.nbytes)
            for start in range(0, len(some), step):
                m = {c: v[start:start + step, None] for c, v in mine.items()}
                i, j = np.nonzero((m["root"] != yours["root"]) & (yours["inmain"] | (yours["node"] > m["node"])) & (
                    yours["own"] | m["own"]) & (100 * np.minimum(yours["size"], m["size"]) >= percent * np.maximum(yours["size"], m["size"])))
                i += start
                apart = np.bitwise_count(ours[i] ^ theirs[j]).sum(1)
                able = apart <= (mine["size"][i] + yours["size"][j]) * (100 - percent) // (100 + percent)
                pairs = pd.DataFrame({"a": mine["node"][i[able]], "b": yours["node"][j[able]], "root": yours["root"][j[able]],
                                      "apart": apart[able]})
                if len(pairs):
                    pairs["again"] = pairs.duplicated(["a", "root"], keep=False) if closest else False
                    out.append(pairs.sort_values("apart").drop_duplicates(["a", "root"]) if closest else pairs)
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "again": []})
        return pd.DataFrame({"chunk": np.full(len(found), key[0], np.int64), "a": np.minimum(found["a"], found["b"]).astype("int64"),
                             "b": np.maximum(found["a"], found["b"]).astype("int64"), "again": found["again"].astype(bool)})
    return run


def _with_payload(pairs: DataFrame, side: str, payload: DataFrame, out: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``pairs`` with the payload of a side (and of equal ``more`` columns); a node of
    many pairs has a copy for every ``TOGETHER`` of them, so that no key is hot."""
    other, keys = "b" if side == "a" else "a", [side, *more]
    copies = pairs.groupBy(*keys).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("copies"))
    salted = pairs.join(copies, keys).withColumn("salt", F.pmod(F.xxhash64(other), "copies").cast("int")).drop("copies")
    spread = payload.withColumnRenamed("node", side).join(copies, keys).select(
        *keys, F.col("payload").alias(out), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    return salted.join(spread, [*keys, "salt"]).drop("salt")


def linked_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, small: int = SMALL_CHUNK,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are the parts between ASCII white space, A-Z in lower case. The set of a
    document is its distinct shingles of ``words`` words; a text of fewer words is one
    shingle; a text without words, null ones included, has the empty set and is linked
    with nothing, not even with another empty one. Documents are linked whose sets have
    ``percent`` hundredths of Jaccard similarity or more; a component is what links
    reach, its id the least doc_id in it (nulls do not count; null if it has only
    nulls). Rows of one doc_id are documents of their own. Shingles are compared by
    64-bit hashes. An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"),
                       F.xxhash64(F.col(text_col)).alias("tkey"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    sketched = written(read.mapInArrow(
        _sketches(words, percent), f"uid bigint, doc_id {kind}, tkey bigint, digest string, size bigint, band int, own boolean, "
        "dense binary, chunks binary"), "parity-sketches")
    rows = sketched.where("own").select("uid", "doc_id", "tkey", "digest", "size")
    firsts = rows.where("size > 0").groupBy("digest").agg(F.min("uid").alias("node"))
    of = written(rows.join(firsts, "digest", "left").select(
        "uid", "doc_id", "tkey", "digest", "size", F.coalesce("node", "uid").alias("node")), "parity-nodes")
    nodes = of.where("uid = node AND size > 0").select("node", "doc_id", "tkey", "digest")
    sketch = written(sketched.withColumnRenamed("uid", "node").join(nodes.select("node"), "node", "left_semi").select(
        "node", "size", "band", "own", "dense", "chunks"), "parity-bands")

    chunks = sketch.select("node", "band", "own", "chunks").mapInArrow(
        _chunk_rows, "chunk bigint, node bigint, band int, own boolean")
    shared = written(chunks.repartitionByRange("chunk", "node").sortWithinPartitions("chunk", "node").mapInArrow(
        _not_alone, "chunk bigint, node bigint, band int, own boolean"), "parity-kept")
    counts = shared.groupBy("chunk").agg(F.count("*").alias("m"), F.max("own").alias("any")).where("m > 1 AND any").drop("any")
    shared = written(shared.join(counts, "chunk"), "parity-shared")

    # candidates: all pairs of small chunks, stars of larger ones; two guests of a band
    # meet in a band below
    few = shared.where(F.col("m") <= small).groupBy("chunk", "band").agg(
        F.sort_array(F.collect_list(F.struct("node", "own"))).alias("all"))  # at most `small` nodes each
    pairs = few.select("band", "all", F.explode("all").alias("a")).select("band", "a", F.explode("all").alias("b")).where(
        "a.node < b.node AND (a.own OR b.own)").select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), "band")
    large = shared.where(F.col("m") > small)
    weight = large.groupBy("node").agg(F.sum("m").alias("weight"))
    hubs = large.where("own").join(weight, "node").groupBy("chunk").agg(
        F.max(F.struct("weight", F.negative("node").alias("order"))).alias("best")).select(
        "chunk", F.negative("best.order").alias("hub"))
    stars = large.join(hubs, "chunk").where("node <> hub").select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), "band")

    def linked(able: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose whole sets have the similarity."""
        wanted = nodes.join(able.select(F.col("a").alias("node")).union(able.select("b")).distinct(), "node")
        texts = docs.select(F.col(id_col).alias("__doc__"), F.xxhash64(F.col(text_col)).alias("__key__"),
                            F.encode(F.col(text_col), "UTF-8").alias("__text__"))
        sets = written(texts.join(wanted, F.col("__doc__").eqNullSafe(F.col("doc_id")) & (F.col("__key__") == F.col("tkey"))).select(
            "node", "digest", "__text__").mapInArrow(
            _elements(words), "node bigint, payload binary").dropDuplicates(["node"]), f"parity-sets-{name}")
        both = _with_payload(_with_payload(able, "a", sets, "x"), "b", sets, "y")
        return written(both.select("a", "b", "x", "y").mapInArrow(
            _passing(_similar(percent)), "a bigint, b bigint"), f"parity-links-{name}")

    tried = written(pairs.union(stars).distinct(), "parity-tried")
    payload = sketch.select("node", "band", F.concat(F.unhex(F.lpad(F.hex("size"), 16, "0")), F.col("dense")).alias("payload"))
    both = _with_payload(_with_payload(tried, "a", payload, "x", ("band",)), "b", payload, "y", ("band",))
    able = written(both.select("a", "b", "x", "y").mapInArrow(
        _passing(_near_enough(percent)), "a bigint, b bigint").distinct(), "parity-able")
    links = linked(able, "0")
    label = components(links, "parity0")

    # chunks whose nodes are in several components: the pairs that the stars did not see
    for closest in (True, False):
        placed = large.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed_ = written(placed.groupBy("chunk", "root").agg(F.count("*").alias("n")).groupBy("chunk").agg(
            F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"),
            F.max("n").alias("most")).where("roots > 1").select(
            "chunk", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK_ROWS).cast("int").alias("rows"),
            F.ceil(F.col("n") / BLOCK_COLS).cast("int").alias("cols")), "parity-mixed")
        if mixed_.isEmpty():
            break
        inside = placed.drop("m").join(mixed_, "chunk").join(
            sketch.select("node", "band", "size", "dense"), ["node", "band"]).withColumn("inmain", F.col("root") == F.col("main"))
        part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        some = inside.where("NOT inmain").select("*", part("rows").alias("row"), F.explode(
            F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
        every = inside.select("*", part("cols").alias("col"), F.explode(
            F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
        every = every.select(*[F.col(c).alias(c) for c in every.columns])  # columns of its own for the cogroup
        keys = ["chunk", "row", "col"]
        more = written(some.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(
            _apart(percent, closest), "chunk bigint, a bigint, b bigint, again boolean"), "parity-apart")
        found = linked(more.select("a", "b").distinct(), f"more-{closest}")
        if not found.isEmpty():
            links = written(links.union(found), "parity-links")
            label = components(links, f"parity-{closest}")
        # only chunks in which a node had several partners in a component go on
        large = large.join(more.where("again").select("chunk").distinct(), "chunk", "left_semi")

    out = of.join(label, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("root", "node").alias("root"))
    ids = out.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return out.join(ids, "root").select("doc_id", "n_shingles", "component_id")
