"""Document operators on small tables with awkward rows, against brute force."""
import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

from boxwise.llm import bpe, exact_dedup, mixing, near_dedup, sharding, toxicity
from boxwise.llm.dart_sketch import Shingler, sketch
from boxwise.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, size string, fp string, norm string, node string"


def table(spark, rows):
    """(doc_id, text[, source]) with further columns named like inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "u", "z", "f", "n", "d") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def awkward(seed=0, n=60):
    rnd = random.Random(seed)
    words = ["the", "of", "über", "naïve", "日本", "a1", "x-y", "don't", "!!", "😀"]
    text = lambda k: " ".join(rnd.choice(words) + str(rnd.randint(0, 50)) for _ in range(k))
    base = text(40)
    rows = [(0, None), (1, ""), (2, "  \t\n "), (3, "one"), (None, "one"), (4, base), (5, base), (5, base), (None, None),
            (6, base.replace(" ", " \n ", 3)), (7, text(4000)), (-8, "negative"), (9, "a b"), (10, "a b")]
    return rows + [(20 + i, text(rnd.randint(1, 60))) for i in range(n)]


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_walk_and_moves_little(spark):
    keys = [0, 1, -1, 2**63 - 1, -2**63, *random.Random(1).sample(range(10**12), 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = df.select("k", sharding.jump_hash(df["k"], 1, 24, 25, 100).alias("s")).collect()
    for r in got:
        assert (r.s.n1, r.s.n24, r.s.n25, r.s.n100) == tuple(jump(r.k, n) for n in (1, 24, 25, 100))
        assert r.s.n25 in (r.s.n24, 24)


def test_shards(spark):
    rows = awkward()
    got = sharding.shard_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(d or 0, 24), jump(d or 0, 25)) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r.law for r in got} == {"key"}
    assert sharding.shard_documents(table(spark, [])).collect() == []


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = awkward(3) + [(900, "x<|endoftext|>y <|endoftext|>"), (901, "a" * 30_000), (902, "\x00\x1c  　z"), (903, "it's I'LL")]
    got = bpe.digests(table(spark, rows), tokenizer_path()).collect()
    want = Counter()
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    two = bpe.decode(bpe.encode(table(spark, rows), tokenizer_path()), tokenizer_path()).select("text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in two)
    assert bpe.digests(table(spark, []), tokenizer_path()).collect() == []


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return groups, least


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(spark, bits):
    """With fingerprints of two bits nearly all rows are suspects, and the result is the same."""
    from pyspark.sql import functions as F
    rows = awkward(5)
    fingerprint = F.xxhash64 if bits == 64 else (lambda c: F.pmod(F.length(c), F.lit(4)).cast("bigint"))
    got = exact_dedup.duplicate_groups(table(spark, rows), fingerprint=fingerprint).collect()
    groups, least = exact_groups(rows)
    want = Counter((d, least[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.duplicate_groups(table(spark, [])).collect() == []


def test_drop_duplicates_keeps_columns_and_one_row_each(spark):
    rows = awkward(5) + [(5, "another text of id five")]
    df = table(spark, rows)
    out = exact_dedup.drop_duplicates(df)
    got = out.collect()
    groups, least = exact_groups(rows)
    assert out.columns == df.columns
    assert Counter((r.doc_id, normal(r.text)) for r in got) == Counter((least[k], k) for k in groups)


def test_golomb_codes():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 3000):
        for top in (200, 2**33, 2**64 - 1):
            v = np.unique(rnd.integers(0, top, min(n, 100) if top == 200 else n, dtype=np.uint64, endpoint=True))
            width, code = exact_dedup.golomb_encode(v)
            assert (exact_dedup.golomb_decode(width, code, len(v)) == v).all()
            if n == 3000 and top == 2**64 - 1:
                assert len(code) < 8 * n * 0.9


def shingles(t):
    w = (t or "").lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def near_classes(rows, weighted=False):
    sets = [shingles(t) for _, t in rows]
    words = [tuple((t or "").lower().split()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if weighted:
                both, either = sum((a & b).values()), sum((a | b).values())
            else:
                both, either = len(a.keys() & b.keys()), len(a.keys() | b.keys())
            if words[i] == words[j] or either and both / either >= 0.8:
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return out


def near_rows(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randint(0, 400)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (None, "one two three")]
    at = 10
    for _ in range(n // 4):
        base = [word() for _ in range(rnd.randint(8, 200))]
        for _ in range(4):
            new = list(base)
            for _ in range(rnd.randint(0, max(1, len(new) // 30))):
                new[rnd.randrange(len(new))] = word()
            rows.append((at, " ".join(new)))
            at += 1
    chain = [word() for _ in range(150)]  # a chain of small steps: far ends are unlike
    for _ in range(12):
        chain = chain[2:] + [word(), word()]
        rows.append((at, " ".join(chain)))
        at += 1
    return rows + [(11, "one  two")]


@pytest.mark.parametrize("small,weighted", [(8, False), (2, False), (8, True)])
def test_near_classes(spark, small, weighted):
    """``small`` 2: nearly all buckets are searched by stars and the second pass."""
    rows = near_rows(7)
    got = near_dedup.near_duplicate_classes(table(spark, rows), small=small, weighted=weighted).collect()
    want = near_classes(rows, weighted)
    sizes = Counter()
    for members in want.values():
        ids = [rows[i][0] for i in members]
        for i in ids:
            sizes[i, min((x for x in ids if x is not None), default=None), len(ids)] += 1
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == sizes
    assert sum(r.kept for r in got) == len(want)
    assert near_dedup.near_duplicate_classes(table(spark, [])).collect() == []


def test_near_rows_are_dropped_with_all_columns(spark):
    rows = near_rows(8)
    df = table(spark, rows)
    out = near_dedup.drop_near_duplicates(df)
    assert out.columns == df.columns and out.count() == len(near_classes(rows))


def test_sketches_estimate_weighted_similarity():
    rnd = np.random.default_rng(3)
    shared, own = rnd.integers(1, 2**63, 300).astype(np.uint64), rnd.integers(1, 2**63, 200).astype(np.uint64)
    w = rnd.integers(1, 9, 300).astype(float)
    a = sketch(shared, 512, w)
    assert (a == sketch(shared[::-1].copy(), 512, w[::-1].copy())).all()
    b = sketch(shared, 512, w + (np.arange(300) % 3))
    assert abs((a == b).mean() - w.sum() / (w + np.arange(300) % 3).sum()) < 0.08
    c = sketch(np.unique(np.r_[shared, own]), 512)
    d = sketch(np.unique(shared), 512)
    assert abs((c == d).mean() - 300 / 500) < 0.08
    assert len(Shingler()(["a"])[0]) == 1 and len(Shingler()([])[0]) == 0


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(1, 90))), rnd.choice(["b", "a", "z", None, "é"]))
            for i in range(300)] + [(500, "x " * 3000, "a"), (501, None, "b"), (502, " \t", "c"), (503, "few words here", "tiny"), (503, "few words here", "tiny")]
    df = table(spark, rows)
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    sources = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over} if over else share
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    taken = Counter()
    for r in got:
        s = r.members[0]
        assert r.source_sizes == [sizes[s]] and abs(r.targets[0] - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)
    again = mixing.mix(df.repartition(7)).collect()
    once = Counter((r.doc_id, r.taken) for r in got if r.doc_id != 503)
    assert once == Counter((r.doc_id, r.taken) for r in again if r.doc_id != 503)
    assert mixing.mix(table(spark, [])).collect() == []


def test_mixed_documents(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2]) for i in range(200)] + [(900, "", "a")]
    df = table(spark, rows)
    out = mixing.mixed_documents(df)
    got = Counter(r.doc_id for r in out.collect())
    assert out.columns == df.columns and max(got.values()) <= 2 and 900 not in got
    sizes = {d: len(t.split()) for d, t, _ in rows}
    total = sum(n * sizes[d] for d, n in got.items())
    assert abs(total - 1.5 * sum(sizes.values())) <= 14


def test_flow_serves_overlapping_sources():
    # only the shared pattern can serve both quotas; the lone one is taken first
    assert mixing.route([((0,), 10), ((0, 1), 10)], [10, 10], 2) == [10, 10]
    assert mixing.route([((0,), 10), ((0, 1), 10)], [25, 15], 2) == [20, 20]
    assert mixing.route([((0, 1), 5)], [100, 0], 2) == [10]
    assert mixing.capped_targets([10, 100, 0], [3, 1, 2], 150, 2) == [20, 130, 0]


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(4)
    clean = ["w%d" % i for i in range(300)] + ["scunthorpe"]
    bad = ["nastyword", "vilething", "foulish"]
    rows, labels = [], []
    for i in range(600):
        toxic = rnd.random() < 0.3
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 60))]
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", "s", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "a N4styw0rd of а vi1ething"), (None, "x"), (1003, "w1 " * 9000)]
    labels = spark.createDataFrame(labels + [(1, 1), (None, 1), (2000, None)], "doc_id long, toxic int")
    df = table(spark, rows)
    lexicon = toxicity.learn(df, labels)
    got = toxicity.score(df, lexicon).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()} | {1: 1}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out and r.doc_id != 1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 50
    by = {r.doc_id: r for r in got}
    assert by[1002].predicted == 1 and by[1000].predicted == by[1001].predicted == by[1003].predicted == 0
    out = toxicity.reject_toxic(df, lexicon)
    assert out.columns == df.columns and out.count() == sum(1 for r in got if not r.predicted)
    none = toxicity.learn(df, labels.limit(0))
    assert {r.predicted for r in toxicity.score(df, none).collect()} <= {0, 1}
    assert toxicity.score(table(spark, []), lexicon).collect() == []


def test_exception_phrases_spare_a_hit():
    m = toxicity.Matcher(toxicity.Lexicon({" trash": 5.0}, [" trash can "]))
    assert m.hits(m.fold("Trash day")) and m.hits(m.fold("TR4SH!")) and not m.hits(m.fold("a trash can stood"))
    assert m.measure("trash " * 10)[1] > m.measure("trash " + "word " * 200)[1]


def test_many_rows_of_one_id_fetch_their_own_texts(spark):
    """Texts of candidates come by id and text, so rows of one id (nulls) stay linear;
    pairs of near copies without ids are still found."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        base = [f"{w}x{i}" for w in words[:60]]
        rows += [(None, " ".join(base)), (None, " ".join([*base[:-1], "end"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_duplicate_classes(df).collect()
    assert len(got) == 300 and all(r.class_size == 2 for r in got) and sum(r.kept for r in got) == 150
