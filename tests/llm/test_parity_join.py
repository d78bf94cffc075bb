"""The parity-sketch join against all pairs."""
import random
import re

import numpy as np
import pytest

from boxwise.llm import parity_join as P
from boxwise.llm.dart_sketch import Shingler


def shingles(text, n=5):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, percent=80, n=5):
    """(doc_id, size, component) of every row, by comparing all pairs."""
    sets, root = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((v for v in (least.get(r), d) if v is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def joined(spark, rows, **options):
    schema = "doc_id long, text string, node string, band string, size string, tkey string, chunk string, root string"
    df = spark.createDataFrame([(d, t, "n", "b", "z", "k", "c", "r") for d, t in rows], schema).repartition(3)
    return sorted((tuple(r) for r in P.linked_components(df, **options).collect()), key=repr)


def changed(rnd, words, times):
    """``words`` with some of them replaced, dropped or doubled."""
    out = list(words)
    for _ in range(times):
        at = rnd.randrange(len(out))
        out[at:at + 1] = rnd.choice([[f"new{rnd.random()}"], [], [out[at], "and"]])
    return out


def corpus(seed):
    """Chains of small changes, groups of many near copies, a passage that a third of
    all texts hold, and texts of all sizes around the bounds of the bands."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    rows, passage = [], fresh(60)
    for n in (1, 3, 4, 5, 6, 7, 8, 9, 19, 20, 21, 60, 67, 68, 69, 90, 259, 260, 300, 1100):
        base = fresh(n)
        for step in range(4):
            rows.append(" ".join(base))
            base = changed(rnd, base, max(1, n // 90)) or ["x"]
    for n, copies in ((120, 40), (40, 25)):
        base = fresh(n)
        rows += [" ".join(changed(rnd, base, rnd.randrange(4))) for _ in range(copies)]
    rows += [" ".join(passage + fresh(rnd.choice((5, 12, 30, 60)))) for _ in range(60)]
    rnd.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent,words,small", [(80, 5, 8), (80, 5, 2), (60, 3, 3), (100, 5, 8)])
def test_all_links(spark, percent, words, small):
    rows = corpus(percent + small)
    assert joined(spark, rows, percent=percent, words=words, small=small) == brute(rows, percent, words)


def test_awkward_rows(spark):
    long = " ".join(f"v{i % 700}" for i in range(9000))
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\f\r"), (3, "One two"), (None, "one  TWO"), (4, "one two"), (None, None),
            (5, "one two three four five"), (6, "ONE TWO THREE FOUR FIVE\n"), (6, "one two three four five"), (7, "é É"),
            (8, "É É"), (9, "a b"), (10, "a b"), (11, " "), (None, "lone null id"), (12, long), (-13, long + " end"), (14, long)]
    got = joined(spark, rows)
    assert got == brute(rows)
    assert {g[2] for g in got if g[0] in (12, -13, 14)} == {-13}
    assert joined(spark, rows[:3]) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert joined(spark, []) == []


def test_many_rows_of_one_id(spark):
    rows = [(1, f"text number {i} of one id with words") for i in range(300)] + [(1, "equal text of an id")] * 300
    assert joined(spark, rows) == brute(rows)


def test_sketches_bound_the_difference_and_similar_sets_share_a_kept_chunk():
    rnd, shingle = random.Random(5), Shingler(1)
    for _ in range(400):
        n = rnd.choice((2, 4, 5, 9, 15, 16, 17, 40, 63, 64, 80, 255, 256, 700, 1023, 1300))
        words = [f"t{rnd.random()}".encode() for _ in range(n * 2)]
        add = rnd.randint(0, n // 4)
        a, _ = shingle(words[:n])
        b, _ = shingle(words[rnd.randint(0, n // 8):n + add])
        same, size = len(np.intersect1d(a, b)), max(len(a), len(b))
        apart = len(a) + len(b) - 2 * same
        band = P.band_of(size)
        x, y = (np.frombuffer(P.dense_sketch(s, band), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= apart
        if 100 * same >= 80 * (len(a) + len(b) - same):
            assert apart <= P.most_different(len(a) + len(b), 80)
            assert band in P.bands_of(len(a), 80) and band in P.bands_of(len(b), 80)
            assert set(P.kept_chunks(a, band, 80)) & set(P.kept_chunks(b, band, 80))


def test_neighbours_in_batches_and_at_the_ends():
    import pyarrow as pa
    chunk = [1, 2, 2, 3, 4, 4, 4, 5, 6, 7, 7, 8]
    for width in (1, 2, 3, 5, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(chunk[i:i + width], pa.int64())], names=["chunk"])
                   for i in range(0, len(chunk), width)]
        got = [c for b in P._not_alone(iter(batches)) for c in b.column(0).to_pylist()]
        assert got == [1, 2, 2, 4, 4, 4, 7, 7, 8]
