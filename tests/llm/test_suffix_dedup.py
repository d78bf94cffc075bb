import hashlib
import random

from pyspark.sql import Row

from boxwise.llm import suffix_dedup as S
from boxwise.llm.suffix_array import longest_matches, suffix_array


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    times = {}
    for r in raws:
        for p in range(len(r) - length + 1):
            times[r[p:p + length]] = times.get(r[p:p + length], 0) + 1
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if times[r[p:p + length]] > 1:
                hit[p:p + length] = b"\1" * length
        kept = bytes(b for b, h in zip(r, hit) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1]))
        out.append((len(r), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts_of(seed, n=60):
    rnd = random.Random(seed)
    words = ["ab", "é", "xyz", "q", "longer", "ñu", "ß"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, other = text(90), text(40)
    out = [None, "", "short", "aaaa" * 90, "word " * 100, passage, passage]
    for _ in range(n):
        base = text(rnd.randint(0, 160))
        kind = rnd.randint(0, 5)
        if kind == 0:
            base = base + " " + passage[rnd.randint(0, 40):] + base
        elif kind == 1:
            base = other + base + other
        elif kind == 2 and out[-1]:
            old = out[rnd.randrange(len(out))] or ""
            at = rnd.randint(0, len(old))
            base = old[:at] + rnd.choice(["Z", "", "ZZ"]) + old[at:]
        out.append(base)
    return out


def run(spark, texts, length, **options):
    df = spark.createDataFrame([Row(doc_id=i, text=t, start="clash", stop=1, flags=2) for i, t in enumerate(texts)],
                               "doc_id long, text string, start string, stop long, flags long").repartition(5)
    got = S.remove_repeats(df, length, **options).collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got, key=lambda r: r.doc_id)]


def test_suffix_array_and_matches():
    rnd = random.Random(0)
    for _ in range(500):
        top = rnd.randint(0, 4)
        s = [rnd.randint(0, top) for _ in range(rnd.randint(0, 30))]
        order = suffix_array(s, top)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        best = longest_matches(s, order)
        for i in range(len(s)):
            longest = 0
            for j in range(len(s)):
                k = 0
                while i != j and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                longest = max(longest, k)
            assert best[i] == longest


def test_against_brute_force(spark):
    for seed, length, large in ((1, 100, 1000), (2, 128, 2), (3, 400, 1)):
        texts = texts_of(seed)
        assert run(spark, texts, length, large_core=large) == brute(texts, length)


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(450))
    df = spark.createDataFrame([(1, long), (1, long), (None, "x" + long[5:440]), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(df).collect())
    assert got == [("1", 450, 450, 1), ("1", 450, 450, 1), ("None", 0, 0, 0), ("None", 436, 435, 1)]
    assert S.remove_repeats(df.limit(0)).collect() == []
