"""Merkle manifest of a table: digests, roots and proofs by slot pivots.

A tree level is one aggregation. A node at position p is the child in slot
``p % fanout`` of parent ``p div fanout``; conditional aggregates spread the
children of a parent into ``fanout`` columns of one row. The hash of these columns
put together is the parent, the columns without the own one are the siblings of a
child. Proofs come down the same rows: a parent's path plus the siblings in front
of and behind each child. A level has an eighth of the rows of the one below, so
all levels together hold less than a seventh of the leaves.

Every group of rows (here: a language) has its own tree, and a tree over the roots
of the groups, in the order of their keys, gives the root of the table.

Positions come from a global order by range partitions, never from a window over a
group, and a parent has at most ``fanout`` children, so no group of any size meets
in one task. The driver learns the number of rows of the largest group, the number
of groups, and the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boxwise.llm.common import written
from boxwise.operators.ordinal import with_ordinal

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def ascii_lower(c: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _heights(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _levels(nodes: DataFrame, most: int, fanout: int, name: str) -> list[DataFrame]:
    """The pivoted levels over ``nodes`` (gid, n, pos, item), lowest first: one row
    (gid, n, pos, digest, c0, c1, ...) for each parent, ``c<slot>`` being the child's
    item and ``n`` the number of nodes of the group on the parents' level. A group
    takes part as long as it has several nodes."""
    out = []
    slot = F.pmod(F.col("pos"), F.lit(fanout))
    slots = [f"c{i}" for i in range(fanout)]
    for k in range(_heights(most, fanout)):
        pivot = nodes.where("n > 1").groupBy("gid", F.expr(f"pos div {fanout}").alias("pos")).agg(
            F.max("n").alias("below"), *[F.max(F.when(slot == i, F.col("item"))).alias(c) for i, c in enumerate(slots)])
        out.append(written(pivot.select(
            "gid", F.expr(f"(below + {fanout - 1}) div {fanout}").alias("n"), "pos",
            digest(*[F.col(c)["digest"] for c in slots]).alias("digest"), *slots), f"{name}-level{k + 1}"))
        nodes = out[-1].select("gid", "n", "pos", F.struct("digest").alias("item"))
    return out


def _with_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Every item of ``nodes`` with the path of siblings up to the end of its group's
    ``path`` in ``tops`` (gid, height, path and more columns, which come along)."""
    more = [c for c in tops.columns if c not in ("gid", "height", "path")]
    slots = [f"c{i}" for i in range(fanout)]
    names = [F.col(c)["digest"] for c in slots]
    children = F.array(*[F.struct(
        (F.col("pos") * fanout + i).alias("pos"), F.col(c).alias("item"),
        F.struct(F.concat_ws("", *names[:i]).alias("before"), F.concat_ws("", *names[i + 1:]).alias("after")).alias("step"))
        for i, c in enumerate(slots)])
    above = None
    for k in range(len(levels), 0, -1):
        own = tops.where(F.col("height") == k).select("gid", F.lit(0).cast("bigint").alias("pos"), "path", *more)
        above = own if above is None else own.unionByName(above.drop("item"))
        above = levels[k - 1].join(above, ["gid", "pos"]).select(
            "gid", "path", *more, F.explode(children).alias("child")).where("child.item IS NOT NULL").select(
            "gid", "child.pos", "child.item", F.concat(F.array("child.step"), F.col("path")).alias("path"), *more)
    lone = nodes.where("n = 1").join(tops.where("height = 0").drop("height"), "gid").select("gid", "pos", "item", "path", *more)
    return lone if above is None else above.unionByName(lone)


def _height(n: Column, fanout: int, most: int) -> Column:
    """The number of levels over ``n`` nodes, ``most`` being the largest ``n``."""
    out, limit, k = F.lit(0), 1, 0
    while limit < most:
        out = F.when(n > limit, F.lit(k + 1)).otherwise(out)
        limit, k = limit * fanout, k + 1
    return out.cast("int")


def manifest(docs: DataFrame, tampered: Column | None = None, forged: dict[str, Column] | None = None,
             fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id",
             fanout: int = FANOUT) -> DataFrame:
    """One row per input row: ``doc_id`` (the key), ``leaf``, ``subroot`` (of its
    group), ``root``, ``proof`` (array of (before, after): the siblings in front of and
    behind the node on every level up to the root), ``proof_sha256``, ``folded_root``
    and ``verified``.

    A leaf is the hash of the ``fields``. Rows where ``tampered`` holds are folded up
    the proof from a leaf in which the fields of ``forged`` have other values;
    ``verified`` tells whether that gives the root.

    Leaves of a group are ordered by key, nulls first; rows of one key by their leaf,
    so that only equal rows can change places, which changes no result. Nulls are
    fields like others, a null group comes first. A group of one row has its leaf as
    subroot, a table of one group that group's subroot as root; a row without
    siblings has the proof hash of the empty string. An empty table gives no rows.
    Columns other than ``fields`` are not read.
    """
    own = {c: docs[c] for c in fields}
    leaf = digest(*[field(c) for c in own.values()])
    forgery = F.lit(None).cast("string") if tampered is None else F.when(
        tampered, digest(*[field((forged or {}).get(c, own[c])) for c in fields]))
    leaves = written(docs.select(
        own[group].alias("grp"), own[key].alias("key"), leaf.alias("digest"), forgery.alias("forged"),
        F.monotonically_increasing_id().alias("place")), "merkle-leaves")
    ordered = with_ordinal(leaves, [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest")], "at")
    # a group is named by the place of its first row, which follows the order of the keys
    groups = written(ordered.groupBy("grp").agg(F.min("at").alias("gid"), F.count("*").alias("n")), "merkle-groups")
    found = groups.agg(F.max("n"), F.count("*")).first()
    most, many = found[0] or 0, found[1]
    nodes = ordered.join(groups.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).select(
        "gid", "n", (F.col("at") - F.col("gid")).alias("pos"), F.struct("digest", "forged", "key").alias("item"))
    levels = _levels(nodes, most, fanout, "merkle")

    # the tree over the groups' roots
    lone = nodes.where("n = 1").select("gid", "item.digest")
    roots = lone
    for level in levels:
        roots = roots.unionByName(level.where("n = 1").select("gid", "digest"))
    tops = with_ordinal(written(roots.join(groups.select("gid", "n"), "gid"), "merkle-subroots"), ["gid"], "pos").select(
        F.lit(0).cast("bigint").alias("gid"), F.lit(many).cast("bigint").alias("n"), "pos",
        F.struct("digest", F.col("gid").alias("group"), F.col("n").alias("rows")).alias("item"))
    over = _levels(tops, many, fanout, "merkle-top")
    root = (over[-1] if over else tops.select("item.digest")).select("digest").first()
    none = F.array().cast("array<struct<before:string,after:string>>")
    start = docs.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("gid"), F.lit(len(over)).alias("height"), none.alias("path"))
    ends = _with_paths(tops, over, start, fanout).select(
        F.col("item.group").alias("gid"), _height(F.col("item.rows"), fanout, most).alias("height"), "path",
        F.col("item.digest").alias("subroot"))
    ends = written(ends, "merkle-ends")

    proven = _with_paths(nodes, levels, ends, fanout)
    folded = F.aggregate("path", F.coalesce("item.forged", "item.digest"),
                         lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))
    return proven.select(
        F.col("item.key").alias(key), F.col("item.digest").alias("leaf"), "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"), F.col("path").alias("proof"),
        F.sha2(F.concat_ws("", F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"])))), 256).alias(
            "proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def audited(docs: DataFrame, every: int = 3) -> DataFrame:
    """The manifest of ``docs`` with the proofs tried on changed texts: the rows whose
    key's checksum ``every`` divides have their text's A to Z in lower case. A row
    without a key is not changed."""
    return manifest(docs, tampered=F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % every == 0,
                    forged={"text": ascii_lower(docs["text"])})
