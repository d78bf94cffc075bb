"""Removal of byte strings of ``length`` or more that occur more than once.

Suffix arrays by induced sorting find the repeats; the input is dealt out so that
each array holds only strings that may repeat each other:

1. Anchors. In every window of ``length`` bytes the least-hashed 32-gram is the
   window's anchor; equal windows have equal anchors at equal places. Successive
   windows with one anchor form a span. Only (anchor hash, span digest, place)
   rows leave this pass.
2. Spans whose digest occurs more than once are repeats as a whole. Of the other
   spans only those whose anchor also occurs in a different span can hold a
   repeat; one text of each different span is fetched.
3. A span's windows fall into blocks by the anchor's place in them. All windows
   of a block share a core, at least ``length - BLOCK + 1`` bytes: blocks can
   repeat each other only if their cores are equal, so they are grouped by core.
4. Shards of such groups get one suffix array each, built by induced sorting over
   left bytes, the core as a single symbol, and right bytes; permuted common
   prefixes say which windows occur elsewhere too.

A core with very many different surroundings is dealt out further, by whole
window, so no group outgrows a shard. Every repeat is found: nothing is sampled,
capped or cut short. Digests have 128 bits.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from boxwise.llm.common import distilled, text_or_empty, utf8, written
from boxwise.llm.suffix_array import longest_matches, suffix_array

LENGTH = 400
GRAM = 32
BLOCK = 32               # windows of a block; at most 63, as their flags are one long
SHARD_SYMBOLS = 150_000  # symbols of one suffix array, about
LARGE_CORE = 1_000       # different surroundings of a core from which it is dealt out by window
BATCH_BYTES = 2_000_000


# --- anchors -----------------------------------------------------------------

def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 32 bytes from each position."""
    h, step = buf.astype(np.uint32) + np.uint32(1), 1
    for odd in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1):
        h = h[:-step] * np.uint32(odd) + h[step:]
        h ^= h >> np.uint32(15)
        step *= 2
    return h


def anchored_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """(first window, last window, anchor) of each span of the texts
    ``buf[starts:ends]``; windows lie within a text."""
    none = np.empty(0, np.int64)
    long = ends - starts >= length
    if not long.any():
        return none, none, none
    width = length - GRAM + 1
    h = gram_hashes(buf)
    ranked = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    rows = np.concatenate([ranked, np.full(-len(h) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(buf) - length + 1
    least = (np.minimum(right[:count], left[width - 1:width - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(count + 1, np.int32)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:count]) > 0)
    anchor = least[window]
    new = np.ones(len(window), bool)
    # the text before ends within `length` bytes of the next one's first window
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    return window[first], window[np.r_[first[1:], len(window)] - 1], anchor[first]


def _pieces(texts, limit: int):
    """Index ranges of ``texts`` (bytes) of about ``limit`` bytes."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _spans(length: int):
    """Rows (doc_id, tkey, text) -> one row per span; a run of equal spans, as in
    periodic text, is one row."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        gram, digest = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        halves = struct.Struct(">qq").unpack
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_pylist()
            texts = [x.as_py() or b"" for x in batch.column(2)]
            for lo, hi in _pieces(texts, BATCH_BYTES):
                own = texts[lo:hi]
                raw = memoryview(b"".join(own))
                sizes = np.array([len(t) for t in own], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                buf = np.frombuffer(raw, np.uint8)
                if len(buf) < length:
                    continue
                first, last, anchor = anchored_spans(buf, starts, ends, length)
                doc = np.searchsorted(ends, first, side="right")
                base = starts[doc]
                rows, before = [], None
                for d, a, b, c, s in zip(doc.tolist(), first.tolist(), (last + length).tolist(), anchor.tolist(), base.tolist()):
                    span = digest(raw[a:b])
                    if before and before[0] == d and before[2] == span and a - s <= before[7]:
                        before[7], before[6] = b - s, before[6] + 1
                        continue
                    h = gram(raw[c:c + GRAM])
                    before = [d, h - (1 << 64) if h >= 1 << 63 else h, span, a - s, b - a, c - a, 1, b - s]
                    rows.append(before)
                if rows:
                    at = pa.array([lo + r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), pa.array([keys[lo + r[0]] for r in rows], pa.int64()),
                         *[pa.array([h[i] for h in (halves(r[2]) for r in rows)], pa.int64()) for i in (0, 1)],
                         *[pa.array([r[i] for r in rows], t) for i, t in (
                             (1, pa.int64()), (3, pa.int64()), (4, pa.int32()), (5, pa.int32()), (6, pa.int64()),
                             (7, pa.int64()))]],
                        names=["doc_id", "tkey", "digest", "digest2", "anchor", "start", "size", "at", "times", "stop"])
    return run


def _blocks(length: int):
    """Texts with their wanted spans -> the blocks of windows of each span."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            rows = []

            def out():
                at = pa.array([r[0] for r in rows], pa.int64())
                return pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), *[pa.array([r[i] for r in rows], t) for i, t in (
                        (1, pa.int64()), (2, pa.int32()), (3, pa.binary()), (4, pa.binary()), (5, pa.binary()),
                        (6, pa.binary()))]],
                    names=["doc_id", "tkey", "first", "windows", "block", "core", "left", "right"])

            for d in range(batch.num_rows):
                text = memoryview(batch.column(2)[d].as_py() or b"")
                for span in batch.column(3)[d].as_py():
                    start, stop = span["start"], span["start"] + span["size"]
                    anchor = start + span["at"]
                    last = stop - length  # of the windows
                    number = (anchor - last) // BLOCK
                    while anchor - number * BLOCK >= start:
                        high = min(last, anchor - number * BLOCK)
                        low = max(start, anchor - (number + 1) * BLOCK + 1)
                        core_at, core_end = anchor - number * BLOCK, anchor - (number + 1) * BLOCK + 1 + length
                        core = digest(text[core_at:core_end])
                        left, right = bytes(text[low:core_at]), bytes(text[core_end:high + length])
                        block = digest(core + len(left).to_bytes(2, "little") + left + right)
                        rows.append((d, low, high - low + 1, block, core, left, right))
                        number += 1
                    if len(rows) > 20_000:
                        yield out()
                        rows.clear()
            if rows:
                yield out()
    return run


# --- suffix arrays -----------------------------------------------------------

def repeated_windows(cores: list, lefts: list[bytes], rights: list[bytes], length: int) -> list[int]:
    """Flags of the windows of each block that also occur in another of the given
    blocks: bit t is the window from the t-th left byte on. Equal cores are equal
    strings of ``length - BLOCK + 1`` bytes."""
    separators = len(cores)
    number = {c: separators + 256 + i for i, c in enumerate(dict.fromkeys(cores))}
    s: list[int] = []
    places = []
    for i, (core, left, right) in enumerate(zip(cores, lefts, rights)):
        places.append(len(s))
        s += [separators + b for b in left]
        s.append(number[core])
        s += [separators + b for b in right]
        s.append(i)  # a symbol of its own: no match goes beyond a block
    best = longest_matches(s, suffix_array(s, separators + 256 + len(number)))
    inner = length - BLOCK  # what a core symbol counts above a byte
    out = []
    for place, left, right in zip(places, lefts, rights):
        flags = 0
        for t in range(len(left) + 1):
            if best[place + t] + inner >= length and best[place + t] > len(left) - t:
                flags |= 1 << t
        out.append(flags)
    return out


def _shard(length: int):
    def run(key, frame):
        import pandas as pd
        flags = repeated_windows([bytes(c) for c in frame["core"]], [bytes(x) for x in frame["left"]],
                                 [bytes(x) for x in frame["right"]], length)
        return pd.DataFrame({"block": frame["block"], "flags": np.array(flags, np.int64)})
    return run


def _windows(length: int):
    """Blocks -> one row per window: its whole content beside the core."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            blocks, bits, contents = [], [], []
            for block, core, left, right, windows in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                for t in range(windows):
                    rest = BLOCK - 1 - (len(left) - t)
                    blocks.append(block)
                    bits.append(t)
                    contents.append(core + bytes([len(left) - t]) + left[t:] + right[:rest])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.binary()), pa.array(bits, pa.int32()), pa.array(contents, pa.binary())],
                names=["block", "bit", "content"])
    return run


def _runs(frames: Iterator) -> Iterator:
    """Flagged windows -> byte ranges (first, stop) of a text."""
    import pandas as pd
    for frame in frames:
        rows = []
        for doc, key, first, flags, size in zip(frame["doc_id"], frame["tkey"], frame["first"], frame["flags"], frame["length"]):
            t, flags = 0, int(flags)
            while flags >> t:
                if flags >> t & 1:
                    a = t
                    while flags >> (t + 1) & 1:
                        t += 1
                    rows.append((doc, key, first + a, first + t + size))
                t += 1
        yield pd.DataFrame(rows, columns=["doc_id", "tkey", "start", "stop"])


def _removed(batches: Iterator) -> Iterator:
    import hashlib
    import pyarrow as pa
    for batch in batches:
        out = []
        for raw, starts, stops in zip(*[batch.column(i) for i in (1, 2, 3)]):
            raw, starts, stops = raw.as_py() or b"", starts.as_py() or [], stops.as_py() or []
            spans = merged_ranges(starts, stops)
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array([r[i] for r in out], t) for i, t in (
                (0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.binary()))]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def merged_ranges(starts, stops) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


# --- the job -----------------------------------------------------------------

def repeated_ranges(docs: DataFrame, length: int = LENGTH, large_core: int = LARGE_CORE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, start, stop): byte ranges that cover every string of
    ``length`` bytes that starts more than once in the texts. ``tkey`` hashes the
    text; rows of equal id and text have the same ranges."""
    if length < BLOCK + 2 * GRAM:
        raise ValueError(f"length must be at least {BLOCK + 2 * GRAM}")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("tkey"),
                        utf8(text_or_empty(text_col)).alias("raw"))
    spans = written(texts.mapInArrow(_spans(length), f"doc_id {kind}, tkey bigint, digest bigint, "
                    "digest2 bigint, anchor bigint, start bigint, size int, at int, times bigint, stop bigint"), "suffix-spans")
    # of equal spans any one will do, in all of its columns
    one = ["doc_id", "tkey", "start", "size", "at", "anchor"]
    kinds = written(spans.groupBy("digest", "digest2").agg(
        F.sum("times").alias("n"), *[F.first(c).alias(c) for c in one]), "suffix-kinds")
    again = kinds.where("n > 1").select("digest", "digest2")
    whole = spans.select("digest", "digest2", "doc_id", "tkey", "start", "stop").join(
        again, ["digest", "digest2"], "left_semi").select("doc_id", "tkey", "start", "stop")

    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    wanted = kinds.select(*one).join(mixed, "anchor", "left_semi")
    wanted = wanted.groupBy(F.col("doc_id").alias("__id__"), F.col("tkey").alias("__key__")).agg(
        F.collect_list(F.struct("start", "size", "at")).alias("spans"))  # of one text, few beside its bytes
    # equal rows give equal blocks: one of them is enough, the counts are in `kinds`
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id__")) & (F.col("tkey") == F.col("__key__"))).select(
        "doc_id", "tkey", "raw", "spans")
    blocks = written(found.mapInArrow(_blocks(length), f"doc_id {kind}, tkey bigint, first bigint, windows int, "
                     "block binary, core binary, left binary, right binary").dropDuplicates(["doc_id", "tkey", "first"]),
                     "suffix-blocks")
    different = written(blocks.groupBy("block", "core").agg(
        F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"),
        F.first("windows").alias("windows")), "suffix-different")
    many = different.groupBy("core").agg(F.count("*").alias("kinds"), F.sum(F.length("left") + F.length("right") + 2).alias("symbols"))
    many = written(many.where("kinds > 1"), "suffix-cores")
    symbols = many.where(F.col("kinds") <= large_core).agg(F.sum("symbols")).first()[0] or 0
    shards = max(1, math.ceil(symbols / SHARD_SYMBOLS))
    # cores of at most `large_core` blocks of at most 2 * BLOCK symbols
    sharded = different.join(many.where(F.col("kinds") <= large_core).select("core"), "core").select(
        "block", "core", "left", "right", F.pmod(F.xxhash64("core"), F.lit(shards)).alias("shard"))
    flags = sharded.groupBy("shard").applyInPandas(_shard(length), "block binary, flags bigint")
    dealt = different.join(many.where(F.col("kinds") > large_core).select("core"), "core").select(
        "block", "core", "left", "right", "windows")
    windows = written(dealt.mapInArrow(_windows(length), "block binary, bit int, content binary").select(
        "block", "bit", F.xxhash64("content").alias("x"), F.md5("content").alias("y")), "suffix-windows")
    twice = windows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    flags = flags.union(windows.join(twice, ["x", "y"], "left_semi").groupBy("block").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("flags")))
    flags = written(flags, "suffix-flags")
    every = F.expr("CASE WHEN n > 1 THEN shiftleft(1L, windows) - 1L END")
    hit = blocks.select("doc_id", "tkey", "first", "block").join(
        different.select("block", "n", "windows"), "block").join(flags, "block", "left").select(
        "doc_id", "tkey", "first", F.coalesce(every, F.col("flags")).alias("flags"), F.lit(length).alias("length")).where(
        "flags <> 0")
    parts = hit.mapInPandas(_runs, f"doc_id {kind}, tkey bigint, start bigint, stop bigint")
    return whole.union(parts)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    kept``. Every byte of the UTF-8 text goes that is covered by a string of
    ``length`` bytes which also starts anywhere else, in the same text or
    another, overlaps included; all strings are judged on the input. ``kept`` is
    binary, as a cut can part a character. Null and empty texts, and texts
    shorter than ``length``, stay as they are; an empty table gives no rows.
    """
    ranges = distilled(docs.sparkSession, "suffix-ranges", lambda: repeated_ranges(
        docs, length, id_col=id_col, text_col=text_col, **options))
    per_text = ranges.distinct().groupBy(F.col("doc_id").alias("__id__"), F.col("tkey").alias("__key__")).agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("tkey"),
                        utf8(text_or_empty(text_col)).alias("raw"))
    joined = texts.join(per_text, F.col("doc_id").eqNullSafe(F.col("__id__")) & (F.col("tkey") == F.col("__key__")), "left")
    return joined.select("doc_id", "raw", "starts", "stops").mapInArrow(
        _removed, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
