"""The registered queries on the small driver tables: their columns, whole tables,
and results that SQL can't express against brute force."""
import glob
import hashlib
import importlib
import re
import sys
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from boxwise.llm import queries as Q
from conftest import SF001

COLUMNS = {
    "op1": {"page_id", "url", "fetched", "verdict", "list", "pattern", "since"},
    "op2": {"page_id", "url", "text", "n_chars"},
    "op3": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op4": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op6": {"doc_id", "class_id", "class_size", "kept"},
    "op7": {"doc_id", "held_out", "score", "predicted"},
    "op8": {"doc_id", "size", "source_size", "target", "taken"},
    "op9": {"query_id", "rank", "vec_id", "score"},
    "op10": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op11": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12": {"doc_id", "n_shingles", "component_id"},
    "op13": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
}


def rows_of(name):
    return pq.read_table(f"{SF001}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    assert name in E.queries()
    df = Q.QUERIES[name](spark, SF001)
    n = name.split("_")[0]
    assert set(df.columns) == COLUMNS[n]
    rows = df.collect()
    docs, pages = rows_of("documents"), rows_of("pages")
    if n in ("op1", "op2"):
        assert sorted(r.page_id for r in rows) == sorted(p["page_id"] for p in pages)
    elif n not in ("op9", "op13"):
        assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in docs)
    CHECKS.get(n, lambda rows, docs: None)(rows, docs)


def check_repeats(rows, docs):
    """Every 400-byte window of the table, and where it starts again."""
    raws = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    starts = defaultdict(int)
    for raw in raws.values():
        for p in range(len(raw) - 399):
            starts[hashlib.blake2b(raw[p:p + 400], digest_size=12).digest()] += 1
    for r in rows:
        raw, covered, runs = raws[r.doc_id], 0, 0
        end, kept = 0, bytearray()
        at = 0
        for p in range(len(raw) - 399):
            if starts[hashlib.blake2b(raw[p:p + 400], digest_size=12).digest()] > 1:
                if p > end or runs == 0:
                    kept += raw[at:p]
                    runs += 1
                    covered += 400
                else:
                    covered += p + 400 - end
                end = at = p + 400
        kept += raw[at:]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), covered, runs)
        assert r.kept_sha256 == hashlib.sha256(bytes(kept)).hexdigest()


def check_mix(rows, docs):
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    total, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        total[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * total[s] + 1e-6 for s in total)
    assert all(r.source_size == total[source[r.doc_id]] for r in rows)


def check_near(rows, docs):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.class_id for r in rows} == {i: find(i) for i in ids}


def check_toxic(rows, docs):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def check_manifest(rows, docs):
    """The trees rebuilt level by level, and every proof from its leaf."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    def leaf(d, text):
        return sha("".join(map(field, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text))))

    def grow(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, node, proof):
        for level in levels[:-1]:
            run, own = level[at // 8 * 8:at // 8 * 8 + 8], at % 8
            proof += run[:own] + run[own + 1:]
            node, at = sha("".join(run[:own] + [node] + run[own + 1:])), at // 8
        return node

    trees, members = {}, defaultdict(list)
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        members[d["lang"]].append(d)
    langs = sorted(members, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        trees[lang] = grow([leaf(d, d["text"]) for d in members[lang]])
    over = grow([trees[lang][-1][0] for lang in langs])
    want = {}
    for g, lang in enumerate(langs):
        for at, d in enumerate(members[lang]):
            hit = zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and d["text"] is not None
            text = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"]) if hit else d["text"]
            proof = []
            top = climb(over, g, climb(trees[lang], at, leaf(d, text), proof), proof)
            want[d["doc_id"]] = (trees[lang][0][at], trees[lang][-1][0], over[-1][0], sha("".join(proof)), top, top == over[-1][0])
    assert {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows} == want
    assert {r.verified for r in rows} == {True, False}


def check_join(rows, docs):
    from test_parity_join import brute
    assert sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in rows), key=repr) == brute(
        [(d["doc_id"], d["text"]) for d in docs])


def check_white(rows, docs):
    """Against a decomposition of the whole matrix."""
    import numpy as np
    own = [(v["vec_id"], v["embedding"]) for v in rows_of("embeddings") if v["embedding"]
           and all(c is not None and np.isfinite(c) for c in v["embedding"])]
    x = np.floor(64 * np.array([v for _, v in own], float)).astype(np.int64) + 1000000
    n, at = len(own), {v: i for i, (v, _) in enumerate(own)}
    centred = x - x.sum(0) / n
    values, units = np.linalg.eigh(centred.T @ centred / n)
    share, units, values = (values / values.sum())[::-1], units[:, ::-1], values[::-1]
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, x.sum(0))) for v in x]
    got = np.zeros((n, 32))
    assert Counter(r.component for r in rows) == {c: n for c in range(1, 33)}
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == exact[at[r.vec_id]] and r.identity_error < 1e-4
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-4
    want = centred @ units[:, :32] / np.sqrt(values[:32])
    signs = np.sign((want * got).sum(0))
    assert np.abs(want * signs - got).max() < 1e-6


CHECKS = {"op11": check_manifest, "op12": check_join, "op13": check_white, "op5": check_repeats, "op8": check_mix, "op6": check_near, "op7": check_toxic}


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]
    docs = Q.table(spark, SF001, "documents")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, SF001).columns == docs.columns
        assert stage(spark, docs.limit(0), SF001).collect() == []
    out = C.run(spark, SF001).collect()
    assert out and all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in out)
    assert max(Counter(r.doc_id for r in out).values()) <= 2
    texts = {d["doc_id"]: d["text"] for d in rows_of("documents")}
    assert all(hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() == r.decoded_sha256 for r in out)


def test_entry_works_without_the_subpackage(monkeypatch):
    """As after deleting the folders and the pipeline file."""
    names = [m for m in sys.modules if m.startswith("boxwise.llm") or m in ("corpus_pipeline", "__spark_entry__")]
    saved = {m: sys.modules.pop(m) for m in names}
    import boxwise
    held = boxwise.__dict__.pop("llm", None)
    real = importlib.import_module

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("boxwise.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    try:
        alone = real("__spark_entry__")
        assert "accuracy" in alone.queries() and not any(k.startswith("op") or k == "pipeline" for k in alone.queries())
    finally:
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(saved)
        if held is not None:
            boxwise.llm = held


def test_nothing_else_imports_the_subpackage():
    for path in glob.glob("boxwise/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "boxwise.llm" not in open(path).read(), path
