"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boxwise.llm import (
    ann, bpe, exact_dedup, merkle, mixing, near_dedup, parity_join, sharding, suffix_dedup, toxicity, url_lists, whitening, wrapper)
from boxwise.llm.common import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


# Captures and list entries that the tables hold by rule: a page's fetch day
# follows its id, a host's list entries follow a hash of its name.
ENTRY_RULES = [  # list, pattern, action, day after 2024-01-01, condition; r is the hash
    ("block", "host", "add", "r % 300", "r % 3 = 0"),
    ("block", "host", "remove", "r % 300 + 90 + r % 50", "r % 6 = 0"),
    ("block", "host", "add", "r % 300 + 400", "r % 12 = 0"),
    ("block", "substring(host, {dot} + 1)", "add", "r % 500", "r % 5 = 0 AND length(host) - length(replace(host, '.', '')) >= 3"),
    ("allow", "concat(host, '/en')", "add", "r % 400", "r % 2 = 0"),
    ("allow", "concat(host, '/en')", "remove", "r % 400 + 200", "r % 4 = 0"),
    ("block", "concat(host, '/de')", "add", "r % 100", "r % 7 < 3"),
    # other forms: capitals, www. and a trailing dot in the host, capitals in the path, a top-level domain
    ("block", "concat('WWW.', upper(host), '.')", "add", "r % 450", "r % 11 = 0"),
    ("allow", "concat(host, '//EN/')", "add", "r % 400", "r % 5 = 1"),
    ("block", "split_part(host, '.', -1)", "add", "r % 600", "r % 13 = 0"),
    ("block", "split_part(host, '.', -1)", "remove", "r % 600 + 5", "r % 13 = 0"),
]


@query
def op1_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_lists.host_and_path(F.col("url"))[0].alias("host")).where("host <> ''").distinct().withColumn(
        "r", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    rules = [F.when(F.expr(when), F.struct(
        F.lit(name).alias("list"), F.expr(pattern.format(dot="locate('.', host)")).alias("pattern"), F.lit(action).alias("action"),
        F.expr(f"date_add(DATE '2024-01-01', {day})").alias("day"))) for name, pattern, action, day, when in ENTRY_RULES]
    entries = hosts.select(F.inline(F.array_compact(F.array(*rules))))
    captures = pages.withColumn("fetched", F.expr("date_add(DATE '2024-01-01', CAST(pmod(page_id, 730) AS INT))"))
    return url_lists.judge_captures(captures, entries).withColumnRenamed("id", "page_id")


ORACLE["op1_temporal_url_lists"] = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (((page_id % 730) + 730) % 730)::INT AS fetched, row_number() OVER () AS uid,
    regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::INT AS r FROM (SELECT DISTINCT host FROM c) WHERE host <> ''),
e AS (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS list, {pattern.format(dot='strpos(host, chr(46))')} AS pattern, '{action}' AS action, "
    f"DATE '2024-01-01' + ({day})::INT AS day FROM h WHERE {when}" for name, pattern, action, day, when in ENTRY_RULES) + r"""),
f AS (SELECT list, action, day, regexp_replace(rtrim(lower(split_part(pattern, '/', 1)), '.'), '^www\.', '') ||
    rtrim(regexp_replace(regexp_replace(pattern, '^[^/]*', ''), '/+', '/', 'g'), '/') AS pattern FROM e),
d AS (SELECT list, pattern, day, bool_or(action = 'add') AS is_on FROM f GROUP BY ALL),
s AS (SELECT *, coalesce(lag(is_on) OVER w, false) AS was FROM d WINDOW w AS (PARTITION BY list, pattern ORDER BY day)),
i AS (SELECT list, pattern, day AS since, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until, is_on FROM s WHERE is_on <> was),
m AS (SELECT c.uid, i.list, i.pattern, i.since, row_number() OVER (PARTITION BY c.uid ORDER BY length(i.pattern) DESC, i.list) AS k
  FROM c JOIN i ON i.is_on AND c.fetched >= i.since AND (i.until IS NULL OR c.fetched < i.until) AND c.host <> ''
   AND (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern) OR starts_with(c.host || c.path || '/', i.pattern || '/')))
SELECT c.page_id, c.url, c.fetched, CASE m.list WHEN 'allow' THEN 'allow' WHEN 'block' THEN 'block' ELSE 'none' END AS verdict,
  m.list, m.pattern, m.since
FROM c LEFT JOIN m ON c.uid = m.uid AND m.k = 1
"""


@query
def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


# CRC-32 by the bytes of the UTF-8 text; the walk of the jump hash by recursion.
ORACLE["op3_jump_shards"] = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
walk(doc_id, k, b, j, n24) AS (
  SELECT DISTINCT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT
                       ELSE coalesce(doc_id, 0)::HUGEINT END), 0::BIGINT, 0::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1.0)))::BIGINT,
         CASE WHEN j < 24 THEN j ELSE n24 END
  FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM walk WHERE j < 25)),
shards AS (SELECT doc_id, max(CASE WHEN b < 24 THEN b END)::INT AS shard, max(b)::INT AS grown_shard
           FROM (SELECT doc_id, unnest([b, n24]) AS b FROM walk) GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, coalesce(octet_length(encode(d.text)), 0)::BIGINT + 8 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(1, 2 * coalesce(octet_length(encode(d.text)), 0)::BIGINT, 2),
          lambda i: ('0x' || substr(hex(encode(d.text)), i, 2))::BIGINT)),
      lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents d, crc_table)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, h.shard,
  row_number() OVER (PARTITION BY h.shard ORDER BY s.doc_id NULLS FIRST, s.size, s.text_crc32) - 1 AS slot, h.grown_shard
FROM sized s JOIN shards h ON s.doc_id IS NOT DISTINCT FROM h.doc_id
"""


@query
def op4_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "kept")


@query
def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query
def op8_flow_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


@query
def op9_balanced_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op10_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op10_golomb_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents")).drop("proof")


# Levels as lists of digests, one row a tree; a proof walks them from its leaf.
_TREE = """
{name}(g, level, d) AS (
  SELECT g, 0, list(digest ORDER BY place) FROM {leaves} GROUP BY g
  UNION ALL
  SELECT g, level + 1, list_transform(range((len(d) + 7) // 8), lambda i: sha256(array_to_string(d[i * 8 + 1:i * 8 + 8], '')))
  FROM {name} WHERE len(d) > 1)"""
_PROOF = """
  SELECT p.uid, p.g, p.level + 1, p.place // 8, p.proof || array_to_string(t.d[r + 1:p.place], '') || array_to_string(t.d[p.place + 2:r + 8], ''),
    sha256(array_to_string(t.d[r + 1:p.place], '') || p.folded || array_to_string(t.d[p.place + 2:r + 8], ''))
  FROM (SELECT *, place // 8 * 8 AS r FROM {name}) p JOIN {tree} t ON t.g = p.g AND t.level = p.level WHERE len(t.d) > 1"""
_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
raw AS (SELECT doc_id, lang, {_leaf("text")} AS digest, {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS forged,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8))) % 3 = 0 AS hit
  FROM documents, crc_table),
leaf AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
    row_number() OVER () AS uid FROM raw),
{_TREE.format(name="tree", leaves="leaf")},
subroot AS (SELECT 0 AS g, g AS own, row_number() OVER (ORDER BY g) - 1 AS place, d[1] AS digest FROM tree WHERE len(d) = 1),
{_TREE.format(name="over_tree", leaves="subroot")},
low(uid, g, level, place, proof, folded) AS (
  SELECT uid, g, 0, place, '', CASE WHEN hit THEN forged ELSE digest END FROM leaf
  UNION ALL {_PROOF.format(name="low", tree="tree")}),
high(uid, g, level, place, proof, folded) AS (
  SELECT l.uid, 0::BIGINT, 0, s.place, l.proof, l.folded
  FROM (SELECT uid, g, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM low GROUP BY uid, g) l JOIN subroot s ON s.own = l.g
  UNION ALL {_PROOF.format(name="high", tree="over_tree")}),
ends AS (SELECT uid, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM high GROUP BY uid),
root AS (SELECT d[1] AS root FROM over_tree WHERE len(d) = 1)
SELECT f.doc_id, f.digest AS leaf, s.digest AS subroot, r.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
  e.folded = r.root AS verified
FROM leaf f JOIN ends e ON e.uid = f.uid JOIN subroot s ON s.own = f.g, root r
"""


@query
def op12_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.linked_components(table(spark, sf_dir, "documents"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "identity_error",
                       F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
