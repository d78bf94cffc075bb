"""Main text of pages by wrapper induction.

The pages of a host share a layout. A bounded sample of each host's pages is
aligned by simple tree matching: texts that stay the same from page to page are
template, nodes whose texts vary are slots. The wrapper of the host keeps the
template texts and the path to the region that holds most of the varying text.
Every page is then read through its host's wrapper: blocks of the region, without
template texts and without the elements that HTML itself marks as navigation,
headers, footers, asides, forms, adverts, notices or comments.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from boxwise.llm.common import written
from boxwise.llm.dom import BLOCK, Branch, Node, parse, tree_matching

SAMPLE_PAGES = 24     # pages of a host that its wrapper is induced from, at most
LEAST_PAGES = 4       # differing pages from which constant text counts as template
CONSTANT = 0.9        # share of them that has a template text
ALIKE = 0.95          # pages that share this much of their text outside constant blocks are copies, not evidence
REGION = 0.9          # the region is the innermost element with this share of varying text
SALTS = 32
DEEPEST = 100         # levels of the layout that are told apart; deeper text counts to level 100

# Elements and class, id or role words that are not main text.
ASIDE_TAGS = frozenset("nav header footer aside form dialog menu search button fieldset head label input output".split())
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor
sponsored promo promos promotion sidebar sidebars nav navbar navigation menu menus menubar breadcrumb breadcrumbs header
masthead topbar footer foot colophon contentinfo complementary comment comments commentlist disqus reply replies respond
cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal
overlay share sharing social related recommended recommendations widget widgets toolbar pagination pager search
copyright""".split())
MAIN_TAGS = frozenset(("html", "body", "main", "article", "#"))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NUMBER = re.compile(r"\b\d+\b")  # views and times, which differ between copies


def is_aside(node: Node) -> bool:
    if node.hidden or node.tag in ASIDE_TAGS:
        return True
    if not node.marks or node.tag in ("html", "body", "main", "#"):
        return False
    return any(w.lower() in ASIDE_WORDS for w in WORD.findall(node.marks))


def squeezed(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(root: Node) -> list[tuple[tuple[str, ...], str]]:
    """(path of labels, text) of each block of a page outside asides, in order. A
    block's text ends where a block begins or ends within it."""
    out: list[tuple[tuple[str, ...], str]] = []
    todo: list = [(root, ("#",))]
    held: list[str] = []
    here = ("#",)

    def flush():
        if held:
            text = squeezed(held)
            if text:
                out.append((here, text))
            held.clear()

    # a stack of nodes still to be read; a path alone marks a block's end
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            held.append(item)
            continue
        node, path = item
        if node is None:
            flush()
            here = path
            continue
        block = node.tag in BLOCK or node.tag == "#"
        if node is not root and is_aside(node):
            if block:
                flush()
            continue
        if block:
            flush()
            here_before, here = here, path
            todo.append((None, here_before))
        for child in reversed(node.children):
            if isinstance(child, str):
                todo.append(child)
            elif child.tag in BLOCK:
                todo.append((child, path + (child.label,) if len(path) < DEEPEST else path))
            else:
                todo.append((child, path))
    flush()
    return out


def reduced(items: list[tuple[tuple[str, ...], str]]) -> Branch:
    """The tree of the blocks' paths; runs of alike blocks are one branch."""
    root = Branch("#")
    for path, text in items:
        at = root
        for label in path[1:]:
            if not at.children or at.children[-1].label != label:
                at.children.append(Branch(label))
            at = at.children[-1]
        at.texts.append(text)
    return root


def differing(pages: list[list]) -> list[list]:
    """The pages without copies. A copy has nearly the same text as a page already
    taken, apart from numbers and from texts that nearly all different pages have: a
    long boilerplate makes no copies of short articles, nor does the page that
    lists an article."""
    pages = [json.loads(x) for x in {json.dumps(items): None for items in pages if items}]
    on: dict[str, int] = {}
    for items in pages:
        for t in {t for _, t in items}:
            on[t] = on.get(t, 0) + 1
    trees: list[tuple[set[str], int, list]] = []
    for items in pages:
        own = {NUMBER.sub("0", t) for t in {t for _, t in items} if on[t] < CONSTANT * len(pages)}
        mass = sum(map(len, own))
        if all(sum(len(t) for t in own & other) < ALIKE * max(mass, size) for other, size, _ in trees):
            trees.append((own, mass, items))
    return [[(tuple(path), text) for path, text in items] for _, _, items in trees]


def merge(into: Branch, page: Branch, seen: dict[int, dict[str, int]]) -> None:
    """Aligns a page's tree with the merged tree: matched nodes count the page and
    its texts, the others are added beside their matched siblings."""
    partner = {id(other): mine for mine, other in tree_matching(into, page)[1]}
    todo = [(into, page)]
    while todo:
        mine, other = todo.pop()
        count = seen.setdefault(id(mine), {})
        for t in set(other.texts):
            count[t] = count.get(t, 0) + 1
        at = 0
        for child in other.children:
            match = partner.get(id(child))
            if match is None:
                match = Branch(child.label)
                match.pages = 0
                mine.children.insert(at, match)
            at = next(i for i, c in enumerate(mine.children) if c is match) + 1
            match.pages += 1
            todo.append((match, child))


def induce(pages: list[str]) -> dict:
    """The wrapper of some pages of one host: ``region`` (path) and ``template``
    (path and text of constant blocks). A text is constant if nearly all of the
    pages that have its node have it there, so every layout has its own template,
    whichever page is the largest."""
    trees = differing(sorted((blocks(parse(p)) for p in pages), key=lambda x: (-len(x), x)))
    if not trees:
        return {}
    merged, seen = Branch("#"), {}
    merged.pages = 0
    for items in trees:
        merged.pages += 1
        merge(merged, reduced(items), seen)
    template, todo = [], [(merged, ("#",))]
    while todo:
        branch, path = todo.pop()
        if branch.pages >= LEAST_PAGES:
            template += [[list(path), t] for t, n in seen[id(branch)].items() if n >= CONSTANT * branch.pages]
        todo += [(c, path + (c.label,)) for c in reversed(branch.children)]
    fixed = {(tuple(p), t) for p, t in template}
    varying: dict[tuple[str, ...], int] = {}
    for items in trees:
        for path, text in items:
            if (path, text) not in fixed:
                for k in range(1, len(path) + 1):
                    varying[path[:k]] = varying.get(path[:k], 0) + len(text)
    return {"region": list(region(varying)), "template": template}


def region(varying: dict[tuple[str, ...], int]) -> tuple[str, ...]:
    """The path of the article, if there is one with a good part of the varying
    text, else of the innermost element that holds nearly all of it."""
    total = varying.get(("#",), 0)
    best, size = ("#",), total
    articles = [(n, p) for p, n in varying.items() if p[-1].partition(".")[0] in ("article", "main") and 4 * n >= total]
    if articles:
        # the outermost article, within the outermost main
        best = min(articles, key=lambda x: (x[1][-1].partition(".")[0] != "article", len(x[1]), -x[0], x[1]))[1]
        return best
    while True:
        inner = [(n, p) for p, n in varying.items() if len(p) == len(best) + 1 and p[:-1] == best and n >= REGION * size]
        if not inner or max(inner)[1][-1].partition(".")[0] in ("p", "li", "td", "pre", "blockquote", "ul", "ol", "table"):
            return best
        best = max(inner)[1]


def main_text(page: str | None, wrapper: dict) -> str:
    """The blocks of the region, joined by single spaces. A page without the
    wrapper's region has its own region sought."""
    items = blocks(parse(page or ""))
    fixed = {(tuple(p), t) for p, t in wrapper.get("template", ())}
    items = [x for x in items if x not in fixed]
    at = tuple(wrapper.get("region", ()))
    inside = [t for p, t in items if at and p[:len(at)] == at]
    if not inside:
        varying: dict[tuple[str, ...], int] = {}
        for path, text in items:
            for k in range(1, len(path) + 1):
                varying[path[:k]] = varying.get(path[:k], 0) + len(text)
        at = region(varying)
        inside = [t for p, t in items if p[:len(at)] == at]
    return " ".join(inside)


# --- Spark -------------------------------------------------------------------

def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def wrappers(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper JSON), from at most ``sample_pages`` different pages of each
    host picked by a hash of their text. Pages without a host are left out."""
    rows = pages.select(host_of(url_col).alias("host"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(
        "host <> '' AND html IS NOT NULL").withColumn("hash", F.xxhash64("html"))
    # one narrow row for each different page of a host: copies neither count nor draw
    different = rows.groupBy("host", "hash").agg(F.min("url").alias("url"))
    counts = different.groupBy("host").agg(F.count("*").alias("n"))
    # thinned to about three samples a host before any window sees them; a host's
    # pages meet its count in SALTS places
    different = different.withColumn("draw", F.pmod("hash", F.lit(1 << 40))).withColumn(
        "salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    thin = different.join(counts, ["host", "salt"]).where(
        F.col("draw").cast("decimal(13,0)") * F.col("n").cast("decimal(20,0)")
        < F.lit((1 << 40) * 3 * sample_pages).cast("decimal(38,0)"))
    rank = F.row_number().over(W.partitionBy("host").orderBy("draw", "hash"))
    picked = thin.withColumn("rank", rank).where(F.col("rank") <= sample_pages).select("url", "hash")
    # the url takes one of the copies; those of the same url too are one row again
    sample = rows.join(picked, ["url", "hash"]).groupBy("url", "hash").agg(
        F.first("host").alias("host"), F.first("html").alias("html")).select("host", "html")

    def run(key, frame):
        import pandas as pd
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(induce(list(frame["html"])))]})

    return sample.groupBy("host").applyInPandas(run, "host string, wrapper string")


def extract_main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars`` (code points). A null
    or empty page has the empty text; a page with no or an unknown host is read
    without template; an empty table gives no rows; other columns are not read."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = written(wrappers(rows, sample_pages), "page-wrappers").withColumnRenamed("host", "__host__")
    joined = rows.withColumn("host", host_of()).join(found, F.col("host") == F.col("__host__"), "left").select(
        "page_id", "url", "html", "wrapper")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        known: dict[str | None, dict] = {None: {}}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2), batch.column(3)):
                wrapper = wrapper.as_py()
                if wrapper not in known:
                    if len(known) > 1000:
                        known = {None: {}}
                    known[wrapper] = json.loads(wrapper)
                texts.append(main_text(page.as_py(), known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn(
        "n_chars", F.length("text").cast("bigint"))
