"""Page, url and vector operators on small tables, against brute force."""
import datetime as dt
import json
import random

import numpy as np

from boxwise.llm import ann, url_lists, wrapper
from boxwise.llm.dom import Branch, tree_matching


def page(title, paragraphs, nav="Home About", note="Accept our cookies please", extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<html><head><title>t</title><style>p{{}}</style></head><body><div id='top-menu'>{nav}</div><div class='wrap'>"
            f"<div class='story'><h1>{title}</h1><div>Subscribe today and save</div>{body}{extra}</div><div class='sidebar'>side {title}</div></div>"
            f"<div>{note}</div><script>var x='<p>no</p>'</script></body></html>")


def test_wrappers_take_constant_text_off_and_keep_what_varies(spark):
    rnd = random.Random(1)
    text = lambda: " ".join("w%d" % rnd.randint(0, 9999) for _ in range(30))
    rows, want = [], {}
    for i in range(8):
        title, paragraphs = f"Title {i}", [text() for _ in range(rnd.randint(1, 5))]
        rows.append((i, f"https://www.site.example/{i}", page(title, paragraphs), "clash", "clash"))
        want[i] = " ".join([title, *paragraphs])
    rows += [(100, "http://other.example/x", None, "c", "c"), (101, None, "", "c", "c"),
             (102, "http://lone.example/", "<p>One &amp;\n two<br>three<b>x</b><p>four<!-- no --><form>f</form>", "c", "c"),
             (103, "http://lone.example/long", "<article>" + "<p>word</p>" * 3000 + "</article>", "c", "c"),
             (104, "bad url", "<article><p>a<div class='comments'><p>reply</div></article><footer>z</footer>", "c", "c"),
             (104, "bad url", "<article><p>a<div class='comments'><p>reply</div></article><footer>z</footer>", "c", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string").repartition(3)
    got = wrapper.extract_main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert {i: by[i] for i in want} == want
    assert by[100] == by[101] == "" and by[102] == "One & two threex four" and by[104] == "a"
    assert by[103] == " ".join(["word"] * 3000)
    assert wrapper.extract_main_text(df.limit(0)).collect() == []


def test_copies_of_one_page_are_no_template():
    same = "<article><p>" + "long text " * 30 + "</p></article>"
    made = wrapper.induce([same] * 10)
    assert made["template"] == [] and wrapper.main_text(same, made) == ("long text " * 30).strip()


def test_copies_do_not_thin_a_host_out(spark):
    def words(i):
        return " ".join("w%d" % (i * 1000 + k) for k in range(30))
    rows = [(f"http://many.example/{i}", page(f"Title {i}", [words(i)])) for i in range(10)]
    copied = [(f"http://many.example/copy{i}", page("Copied", [words(99)])) for i in range(4000)]
    df = spark.createDataFrame(rows + copied + copied[:50], "url string, html string").repartition(4)
    made = json.loads(wrapper.wrappers(df).collect()[0].wrapper)
    assert "Subscribe today and save" in {t for _, t in made["template"]}
    for i, (_, html) in enumerate(rows):
        assert wrapper.main_text(html, made) == f"Title {i} {words(i)}"


def test_short_articles_under_long_boilerplate_have_a_template():
    plates = ["Boiler %d " % k + "plate " * 100 for k in range(3)]
    names = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]

    def html(own):
        return "<body>" + "".join(f"<div><div>{x}</div></div>" for x in plates) + f"<div class='own'><p>{own}</p></div></body>"
    made = wrapper.induce([html(f"{n} is short") for n in names])
    assert {t for _, t in made["template"]} == {" ".join(x.split()) for x in plates}
    assert [wrapper.main_text(html(f"{n} is short"), made) for n in names] == [f"{n} is short" for n in names]
    # the same text but for a number is still a copy
    assert wrapper.induce([html(f"read {i} times") for i in range(8)])["template"] == []


def test_every_layout_has_its_template():
    names = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]

    def article(n):
        return f"<body><div class='a'><h1>{n}</h1><div class='x'>Read our magazine</div><p>text of {n} and more</p></div></body>"

    def listing(n):
        return "<body><div class='l'><h2>All entries</h2>" + "".join(
            f"<h3>{n} {k}</h3><p>about {n} {k}</p>" for k in range(9)) + "</div></body>"
    for listed in (1, 6):
        made = wrapper.induce([article(n) for n in names] + [listing("list " + n) for n in names[:listed]])
        assert [wrapper.main_text(article(n), made) for n in names] == [f"{n} text of {n} and more" for n in names]
    assert "All entries" in {t for _, t in made["template"]}


def test_tree_matching_is_the_largest_order_preserving_one():
    def tree(spec):
        b = Branch(spec[0])
        b.children = [tree(c) for c in spec[1:]]
        return b
    a = tree(("r", ("x", ("p",), ("q",)), ("y",), ("x", ("p",))))
    b = tree(("r", ("y",), ("x", ("p",), ("z",), ("q",))))
    weight, pairs = tree_matching(a, b)
    assert weight == 4 and len(pairs) == 4
    assert tree_matching(a, tree(("s",))) == (0, [])


def test_hostile_pages_end():
    for bad in ("<a '" * 5000, "<" * 20000, "<!" * 20000, "<div>" * 20000, "</p>" * 20000, "<script>" * 5000, "&#x110000;&#" * 3000):
        wrapper.main_text(bad, {})


def brute_verdict(url, day, events):
    host, path = None, ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c)[0]
        host, _, path = rest.partition("/")
        host = host.split("@")[-1].split(":")[0].lower().rstrip(".").removeprefix("www.")
    if not host or day is None:
        return "none", None
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
    parts = [p for p in path.split("/") if p]
    keys += [host + "/" + "/".join(parts[:i]) for i in (1, 2) if i <= len(parts)]
    best = None
    for name in ("allow", "block"):
        for k in keys:
            state = False
            for d in sorted({e[3] for e in events if e[0] == name and e[1] and e[1].lower() == k and e[3]}):
                if d <= day:
                    state = any(e[2] == "add" for e in events if e[0] == name and e[1] and e[1].lower() == k and e[3] == d)
            if state and (best is None or len(k) > len(best[1])):
                best = name, k
    return best or ("none", None)


def test_captures_meet_the_entries_of_their_day(spark):
    rnd = random.Random(6)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rnd.randint(0, 400))
    hosts = ["a.example", "b.a.example", "c.b.a.example", "other.test", "x.test"]
    events = [(rnd.choice(["block", "allow"]), rnd.choice(hosts) + rnd.choice(["", "", "/n", "/n/m"]), rnd.choice(["add", "remove"]), day())
              for _ in range(150)] + [(None, "a.example", "add", day()), ("block", None, "add", day()), ("block", "x.test", "add", None)]
    urls = ["https://www.%s/" % h for h in hosts] + ["http://u@%s:80/n/m/o?q#f" % h.upper() for h in hosts] + [
        "https://%s./n" % h for h in hosts] + [None, "", "not a url", "http:///x"]
    caps = [(i, rnd.choice(urls), rnd.choice([None, *[day() for _ in range(9)]])) for i in range(300)]
    caps += [caps[0], caps[0], (None, "https://a.example/", day())]
    entries = spark.createDataFrame(events, "list string, pattern string, action string, day date")
    df = spark.createDataFrame([(*c, "m", 1) for c in caps], "page_id long, url string, fetched date, pattern string, m int")
    got = url_lists.judge_captures(df, entries).collect()
    assert len(got) == len(caps)
    for r in got:
        assert (r.verdict, r.pattern) == brute_verdict(r.url, r.fetched, events), r
    assert {r.verdict for r in url_lists.judge_captures(df, entries.limit(0)).collect()} == {"none"}
    assert url_lists.judge_captures(df.limit(0), entries).collect() == []
    assert url_lists.block_listed(df, entries).count() == sum(r.verdict == "block" for r in got)


def test_entries_are_read_as_urls_are(spark):
    """Case of hosts and paths, ``www.``, trailing dots, top-level domains, entries
    without a host; a capture far in the future adds no interval rows."""
    import datetime as dt
    day = dt.date(2024, 1, 1)
    entries = spark.createDataFrame([("block", p, "add", day) for p in (
        "A.example/News", "www.B.example", " c.example. ", "zip", "d.example//x/", "/nohost", "", None)],
        "list string, pattern string, action string, day date")
    urls = {"http://a.example/News/x": "block", "http://A.EXAMPLE/news/x": "none", "http://www.b.example/": "block",
            "http://c.example/y": "block", "http://x.zip/": "block", "http://d.example/x/y": "block",
            "http://d.example/xy": "none", "http://e.example/nohost": "none"}
    rows = [(i, u, dt.date(2024, 2, 1)) for i, u in enumerate(urls)] + [(99, "http://x.zip/", dt.date(9999, 12, 31))]
    got = url_lists.judge_captures(spark.createDataFrame(rows, "page_id int, url string, fetched date"), entries).collect()
    assert {r.url: r.verdict for r in got if r.id != 99} == urls
    assert [r.verdict for r in got if r.id == 99] == ["block"]


def test_entries_of_any_depth_are_met(spark):
    day = dt.date(2024, 1, 1)
    entries = spark.createDataFrame([("block", "a.example/x/y/z", "add", day), ("allow", "a.example/x/y/z/1/2/3", "add", day)],
                                    "list string, pattern string, action string, day date")
    urls = {"http://a.example/x/y": "none", "http://a.example/x/y/z": "block", "http://a.example/x//y/z/1/2?q": "block",
            "http://a.example/x/y/z/1/2/3/4": "allow", "http://a.example/": "none", "http://b.example/x/y/z": "none"}
    df = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    assert {r.url: r.verdict for r in url_lists.judge_captures(df, entries).collect()} == urls


def brute_nearest(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q)
            out[q] = near[:k]
    return out


def test_nearest_neighbours(spark):
    rnd = np.random.default_rng(5)
    centers = rnd.normal(size=(12, 16))
    rows = [(i, [float(x) for x in np.float32(centers[i % 12] + 0.4 * rnd.normal(size=16))]) for i in range(3000)]
    rows += [(4000 + i, rows[0][1]) for i in range(40)]  # equal vectors: ties by id
    rows += [(10_000, None), (10_100, []), (10_200, [0.0] * 16), (10_300, [None] + [1.0] * 15), (10_400, [float("nan")] * 16),
             (10_500, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (10_600, [1.0] * 3)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id long, embedding array<float>, list string, part int").repartition(4)
    got = {}
    for r in ann.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute_nearest([r for r in rows if r[1] is None or len(r[1]) != 3], 100, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        mine = [got[q][i] for i in range(1, 11)]
        assert mine == sorted(mine)
        hits += len({i for _, i in mine} & {i for _, i in near})
    assert hits >= 0.9 * 10 * len(want)
    tie = [i for _, i in (got[4000][k] for k in range(1, 11))]
    assert tie == [0, *range(4001, 4010)]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest_neighbours(df).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 100, 1.414214), (100, 1, 3, 1.0), (100, 2, 0, 1.414214)]
    assert ann.nearest_neighbours(df.limit(0)).collect() == []
    assert ann.nearest_neighbours(df.where("vec_id = 0")).collect() == []


def test_every_query_has_its_k_rows(spark):
    rnd = np.random.default_rng(7)
    rows = [(1 + i, rnd.normal(size=8)) for i in range(1, 2999) if (1 + i) % 100]
    far, other = np.full(8, 1000.0), np.full(8, -1000.0)
    rows += [(100, far), (200, other)]  # one alone, one among rows of a single id
    rows += [(7, other + 0.1 * rnd.normal(size=8)) for _ in range(400)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest_neighbours(df, list_rows=8, probes=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: sorted(x) for q, x in got.items()} == {q: list(range(1, 11)) for q in (100, 200)}
    assert got[200][1] == 7 and all(len(set(x.values())) == 10 for x in got.values())
    one = spark.createDataFrame([(7, [9.0, 100 + i / 100]) for i in range(40)] + [(i, [9.0, float(i)]) for i in range(100, 112)],
                                "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.nearest_neighbours(one, list_rows=1000).collect()] == [7, *range(101, 110)]


def test_probes_follow_the_recall(spark):
    rnd = np.random.default_rng(9)
    points = rnd.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest_neighbours(df, list_rows=10, probes=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest([(i, list(v)) for i, v in enumerate(points)], 100, 10)
    assert sum(len(got[q] & {i for _, i in near}) for q, near in want.items()) >= 0.9 * 10 * len(want)
