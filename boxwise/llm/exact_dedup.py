"""Exact deduplication by a Golomb-coded exchange of fingerprints.

1. Every row gets a 64-bit fingerprint of its normalised text; the narrow rows
   are written once.
2. Each part of that table sorts its fingerprints, and sends every owner (a
   range of the fingerprint space) one message: the gaps between its distinct
   fingerprints, Golomb-coded. Copies inside a part travel once.
3. An owner decodes its messages, and answers each with a bitmap: which of the
   sent fingerprints it got from more than one part.
4. Rows whose fingerprint occurs more than once are suspects. Only their texts
   are shuffled and compared byte by byte; fingerprints that meet by chance are
   parted there, so the result depends on bytes alone.

Texts are equal when identical after each run of white space (U+0020, U+0009 to
U+000D) became one space; a null text counts as empty. The row of least doc_id
stays (null ids last); of repeated rows with that id, one stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from boxwise.llm.common import shuffle_partitions, text_or_empty, utf8, written

ROWS_PER_OWNER = 2_000_000  # bounds an owner's memory: 8 bytes a fingerprint


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


# --- Golomb coding of sorted unsigned 64-bit integers ------------------------

def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(width of the remainders, code) of strictly increasing uint64 ``values``.

    Gaps are coded with the parameter ``2^width`` nearest to their mean (the Rice
    case of Golomb codes): all unary quotients first, then all remainders."""
    if not len(values):
        return 0, b""
    gaps = np.empty(len(values), np.uint64)
    gaps[0] = values[0]
    gaps[1:] = np.diff(values)
    # the first value is not a gap: it is sent whole before the code
    rest = gaps[1:]
    mean = float(rest.astype(np.float64).mean()) if len(rest) else 1.0
    width = int(max(0, np.floor(np.log2(max(mean * 0.69, 1.0)))))
    head = int(values[0]).to_bytes(8, "little")
    if not len(rest):
        return width, head
    quotient = (rest >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(width, dtype=np.uint64)
    remainder = ((rest[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8).ravel()
    packed = np.packbits(unary).tobytes()
    return width, head + len(packed).to_bytes(8, "little") + packed + np.packbits(remainder).tobytes()


def golomb_decode(width: int, code: bytes, count: int) -> np.ndarray:
    if not count:
        return np.empty(0, np.uint64)
    first = np.frombuffer(code, "<u8", 1).astype(np.uint64)
    if count == 1:
        return first
    size = int.from_bytes(code[8:16], "little")
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, 16))
    stops = np.flatnonzero(unary == 0)[: count - 1]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(width)
    if width:
        bits = np.unpackbits(np.frombuffer(code, np.uint8, -1, 16 + size))[: (count - 1) * width]
        gaps += bits.reshape(count - 1, width).astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
    return np.concatenate([first, gaps]).cumsum(dtype=np.uint64)


# --- exchange ----------------------------------------------------------------

def _messages(owners: int):
    """Rows of one part -> one row for each owner it has fingerprints for."""
    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        order = np.argsort(fp, kind="stable")
        fp, uid = fp[order], rows["uid"].to_numpy(np.int64)[order]
        owner = ((fp >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        out = []
        sender = int(uid.min())
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(fp)]):
            distinct, place, times = np.unique(fp[a:b], return_inverse=True, return_counts=True)
            width, code = golomb_encode(distinct)
            out.append((int(owner[a]), sender, width, len(distinct), code,
                        np.packbits(times > 1).tobytes(), uid[a:b].tolist(), place.tolist()))
        yield pd.DataFrame(out, columns=["owner", "sender", "width", "n", "code", "local", "uids", "places"])
    return run


def _answers(key, frame):
    """All messages of an owner -> a bitmap for each."""
    import pandas as pd
    sent = [golomb_decode(int(w), bytes(c), int(n)) for w, c, n in zip(frame["width"], frame["code"], frame["n"])]
    values, times = np.unique(np.concatenate(sent), return_counts=True)
    shared = values[times > 1]
    bits = [np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in sent]
    return pd.DataFrame({"owner": frame["owner"].to_numpy(), "sender": frame["sender"].to_numpy(), "bits": bits})


def _suspects(frames: Iterator) -> Iterator:
    import pandas as pd
    for frame in frames:
        out = []
        for uids, places, local, bits in zip(frame["uids"], frame["places"], frame["local"], frame["bits"]):
            hit = np.unpackbits(np.frombuffer(bytes(local), np.uint8)) | np.unpackbits(np.frombuffer(bytes(bits), np.uint8))
            out.append(np.asarray(uids, np.int64)[hit[np.asarray(places, np.int64)] > 0])
        yield pd.DataFrame({"uid": np.concatenate(out) if out else np.empty(0, np.int64)})


def suspect_ids(rows: DataFrame) -> DataFrame:
    """The ``uid`` of every row of ``rows`` (uid, fp) whose fingerprint another row has too."""
    spark = rows.sparkSession
    owners = max(shuffle_partitions(spark), rows.count() // ROWS_PER_OWNER + 1)
    messages = written(rows.select("uid", "fp").mapInPandas(
        _messages(owners), "owner long, sender long, width int, n int, code binary, local binary, "
                           "uids array<long>, places array<int>"), "dedup-messages")
    answers = messages.select("owner", "sender", "width", "n", "code").groupBy("owner").applyInPandas(
        _answers, "owner long, sender long, bits binary")
    return messages.select("owner", "sender", "local", "uids", "places").join(
        answers, ["owner", "sender"]).mapInPandas(_suspects, "uid long")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256,
    text_bytes``. An empty table gives no rows; other columns are not read.

    ``fingerprint`` maps the normalised text to a bigint; any function gives the
    same result, a poor one only makes more suspects.
    """
    norm = normalised(text_col)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", fingerprint(F.col("norm")).alias("fp"),
        F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("text_bytes")), "dedup-rows")
    marked = written(rows.join(suspect_ids(rows).withColumn("suspect", F.lit(True)), "uid", "left"), "dedup-marked")
    suspects = marked.where("suspect").select(F.col("doc_id").alias("id"), F.col("fp").alias("sfp"))

    # the texts of the suspects, found by id and fingerprint; unequal texts of one
    # fingerprint fall into different groups here
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn(
        "fp", fingerprint(F.col("norm")))
    texts = texts.join(suspects, (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("fp") == F.col("sfp")), "left_semi")
    groups = written(texts.groupBy("fp", "norm").agg(
        F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id")).select(
            "fp", F.unhex(F.sha2("norm", 256)).alias("gsha"), "group_size", "keep_id",
            F.crc32(utf8(F.reverse("norm"))).alias("check")), "dedup-groups")
    clash = groups.groupBy("fp", "gsha").count().where("count > 1")
    if not clash.isEmpty():
        raise RuntimeError("two different texts have one SHA-256 digest")
    group = groups.select(F.col("fp").alias("gfp"), "gsha", "group_size", "keep_id")
    joined = marked.join(group, (F.col("fp") == F.col("gfp")) & (F.col("sha") == F.col("gsha")), "left").select(
        "uid", "doc_id", F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        "sha", "text_bytes")
    # of repeated rows with the least id, the first one stays
    first = joined.where("doc_id <=> keep_id and group_size > 1").groupBy("sha").agg(F.min("uid").alias("first_uid"))
    return joined.join(first.withColumnRenamed("sha", "fsha"), F.col("sha") == F.col("fsha"), "left").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("uid") == F.col("first_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "text_bytes")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``. Where one id has several
    equal rows, one of them stays; where it has different texts, each is judged
    on its own."""
    groups = written(duplicate_groups(docs, id_col, text_col), "dedup-decided")
    kept = groups.where("kept").select(F.col("doc_id").alias("__id__"), F.col("text_sha256").alias("__sha__"))
    sha = F.sha2(normalised(text_col), 256)
    out = docs.join(kept, (F.col(id_col).eqNullSafe(F.col("__id__"))) & (sha == F.col("__sha__")), "left_semi")
    if groups.where("not kept and doc_id <=> keep_id").isEmpty():
        return out
    out = out.withColumn("__sha__", sha)
    return out.dropDuplicates([id_col, "__sha__"]).drop("__sha__")
