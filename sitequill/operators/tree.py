"""Document trees from captured sidebars, tree verification against sitemap
URLs, and breadcrumb healing.

A tree is an adjacency relation ``(site, node_id, parent_id, title, level,
url, sib_ord)``; node 0 is the root. Trees come from one page's DOM (per-page
extraction); verification and healing are joins over all sites at once.
"""

from __future__ import annotations

from collections import Counter
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut_lineage
from . import extract as X
from .extract import list_items
from .htmltree import Node, parse, select_any
from .selectors import compile_group

ROOT_TITLE = "Documentation Root"
FLAT_MIN_TOCLINKS = 3
# Breadcrumb heads that are dropped before healing.
CRUMB_HEADS = ["home", "docs"]
# Breadcrumb items.
BREADCRUMB_SELECTORS = compile_group("nav[aria-label='Breadcrumb'] li, .gitbook-breadcrumbs a")


def _is_toclink(n: Node) -> bool:
    return n.tag == "a" and any("toclink" in c for c in n.classes)


def layout_kind(root: Node) -> tuple[str, int]:
    n = len(root.find_all(_is_toclink))
    return ("flat" if n > FLAT_MIN_TOCLINKS else "nested"), n


def _target(link: Node, base_url: str) -> str | None:
    href = link.get("href")
    return urljoin(base_url, href).partition("#")[0] if href else None


def _enclosing_items(n: Node) -> list[Node]:
    """The ``li`` elements around a node, nearest first."""
    found = []
    while (n := n.parent) is not None:
        if n.tag == "li":
            found.append(n)
    return found


def _links_below(link: Node) -> list[Node]:
    """Table-of-contents links that belong under one: for each list beside it
    in its item the first such link of every entry, elsewhere every one."""
    found: list[Node] = []
    for part in (_enclosing_items(link) or [Node("li")])[0].elements():
        if part.tag == "a":
            continue
        inner = part if part.tag == "ul" else part.find(lambda n: n.tag == "ul") if part.tag == "div" else None
        if inner is None:
            found += part.find_all(_is_toclink)
        else:
            firsts = (li.find(_is_toclink) for li in inner.elements() if li.tag == "li")
            found += [a for a in firsts if a is not None]
    return found


def _flat_nodes(root: Node, base_url: str):
    """(parent, title, level, url) of flat layouts; a URL is placed once."""
    links = root.find_all(_is_toclink)
    depths = [len(_enclosing_items(a)) for a in links]
    todo = [(a, 0, 1) for a, d in zip(links, depths, strict=True) if d == min(depths)][::-1]
    placed: set[str] = set()
    count = 0
    while todo:
        link, parent, level = todo.pop()
        url = _target(link, base_url)
        if url in placed:
            continue
        if url:
            placed.add(url)
        count += 1
        yield parent, link.text(strip=True), level, url
        todo += [(a, count, level + 1) for a in reversed(_links_below(link))]


def _nested_nodes(root: Node, base_url: str):
    """(parent, title, level, url) of nested lists. A header without a list of
    its own takes the links that follow it in its list, up to the next header."""
    top = root.find(lambda n: n.tag == "ul")
    header_of: dict[int, int | None] = {}  # by holder: the header that takes the next links
    for i, item in enumerate(list_items(top) if top is not None else []):
        if item.link is None:
            title, url, parent = (item.labels or ["Unknown"])[0], None, item.holder + 1
            header_of[item.holder] = None if item.holds_list else i + 1
        else:
            title, url = item.link.text(strip=True), _target(item.link, base_url)
            parent = header_of.get(item.holder) or item.holder + 1
        yield parent, title, item.level, url


def build_tree(root: Node, base_url: str) -> list[tuple]:
    """Nodes (node_id, parent_id, title, level, url, sib_ord) of a page's tree;
    ids count from 1 in document order, 0 is the root."""
    rows = _flat_nodes if layout_kind(root)[0] == "flat" else _nested_nodes
    siblings: Counter[int] = Counter()
    nodes = []
    for node_id, (parent, title, level, url) in enumerate(rows(root, base_url), 1):
        nodes.append((node_id, parent, title, level, url, siblings[parent]))
        siblings[parent] += 1
    return nodes


def breadcrumbs(root: Node) -> list[str]:
    """Texts of the breadcrumb items (``BREADCRUMB_SELECTORS``): non-blank, not ``/``."""
    out = []
    for el in select_any(root, BREADCRUMB_SELECTORS):
        t = el.text(strip=False).strip()
        if t and t != "/":
            out.append(t)
    return out


# -- Spark jobs -------------------------------------------------------------------

def _tree_rows(url, html):
    yield from build_tree(parse(html), url)


def _layout_rows(url, html):
    yield layout_kind(parse(html))


def _crumb_rows(url, html):
    root = parse(html)
    yield breadcrumbs(root), X.document_title(root)


def page_trees(pages: DataFrame) -> DataFrame:
    """(page_id, node_id, parent_id, title, level, url, sib_ord) for every page."""
    return X.map_pages(pages, _tree_rows,
                       "node_id int, parent_id int, title string, level int, url string, sib_ord int")


def page_layouts(pages: DataFrame) -> DataFrame:
    return X.map_pages(pages, _layout_rows, "layout string, n_toclinks int")


def page_crumbs(pages: DataFrame, keep_url: bool = False) -> DataFrame:
    return X.map_pages(pages, _crumb_rows, "crumbs array<string>, page_title string", keep_url=keep_url)


def missing_from_tree(tree: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Sitemap URLs whose key (``#`` cut, trailing ``/`` stripped) is not a tree URL."""
    keys = tree.where(F.col("url").isNotNull()).select("site", U.tree_key("url").alias("k")).distinct()
    return sitemap_urls.withColumn("k", U.tree_key("url")).join(keys, ["site", "k"], "left_anti").drop("k")


def heal_tree(tree: DataFrame, missing: DataFrame, crumbs: DataFrame) -> DataFrame:
    """Nodes to add so every missing URL hangs under its breadcrumb path, as if
    the URLs were restored one after the other in the order of their names:
    pages and directories restored earlier serve later ones as parents.

    tree(site, node_id, parent_id, title, level, url, sib_ord) with root 0;
    missing(site, url); crumbs(site, url, crumbs, page_title).
    A leading ``home``/``docs``/root-title crumb is dropped; the last crumb is
    the page title; each other crumb names a directory: the first child of
    that title in any case, else a new one. No crumbs: the page goes under the
    root with the document's title.

    Paths form a trie that is built by depth for all sites at once. At a depth,
    everything below one node with one title meets in an aggregate: the child
    that the tree has, else the first URL's contribution, which is a directory
    if the URL goes on and a page if it ends there. That child is the node that
    all paths with this title go on from. A directory that very many paths
    share is aggregated partly before the shuffle.
    Returns new nodes (site, node_id string, parent_id string, title, level, url).
    """
    c = missing.join(crumbs, ["site", "url"], "left").select(
        "site", "url", F.coalesce("crumbs", F.array().cast("array<string>")).alias("cr"), "page_title")
    heads = F.array(*[F.lit(h) for h in CRUMB_HEADS + [ROOT_TITLE.lower()]])
    cut = F.when((F.size("cr") > 0) & F.array_contains(heads, F.lower(F.element_at("cr", 1))),
                 F.slice("cr", 2, 1 << 20)).otherwise(F.col("cr"))
    c = c.select("site", "url", "page_title", F.size("cr").alias("n_raw"), cut.alias("cr"))
    own_title = F.when(F.col("n_raw") == 0, F.col("page_title")).otherwise(F.coalesce(F.try_element_at("cr", F.lit(-1)), F.lit("Untitled")))
    dirs = F.when(F.size("cr") > 0, F.slice("cr", 1, F.size("cr") - 1)).otherwise(F.array().cast("array<string>"))
    kids = (tree.groupBy("site", F.col("parent_id").cast("string").alias("node"), F.lower("title").alias("key"))
            .agg(F.min_by(F.struct(F.col("node_id").cast("string").alias("id"), F.col("level").alias("level")), F.col("sib_ord")).alias("had")))
    state = cut_lineage(c.select("site", "url", own_title.alias("own_title"), dirs.alias("dirs"), F.lit("0").alias("node"), F.lit(0).alias("lvl")))
    depth, added = 0, []
    while True:  # every round goes one directory deeper, so the longest path bounds the rounds
        here = state.withColumn("goes_on", F.size("dirs") > depth)
        here = here.withColumn("title", F.when(F.col("goes_on"), F.get("dirs", F.lit(depth))).otherwise(F.col("own_title")))
        here = here.withColumn("key", F.lower("title"))
        pages = here.where(~F.col("goes_on"))
        added.append(pages.select("site", F.concat(F.lit("page:"), "url").alias("node_id"), F.col("node").alias("parent_id"),
                                  "title", (F.col("lvl") + 1).alias("level"), "url"))
        first = here.groupBy("site", "node", "key").agg(
            F.min(F.struct("url", "goes_on", "title", "lvl")).alias("f"), F.max("goes_on").alias("needed"))
        under = F.when(F.col("node").startswith("dir:"), F.col("node")).otherwise(F.concat(F.lit("dir:"), "node"))
        made = F.when(F.col("f.goes_on"), F.concat(under, F.lit("/"), "key")).otherwise(F.concat(F.lit("page:"), "f.url"))
        child = first.where("needed").join(kids, ["site", "node", "key"], "left").select(
            "site", "node", "key", F.coalesce("had.id", made).alias("child"), F.coalesce("had.level", F.col("f.lvl") + 1).alias("clvl"),
            (F.col("had").isNull() & F.col("f.goes_on")).alias("new"), F.col("f.title").alias("title"))
        child = cut_lineage(child)
        added.append(child.where("new").select("site", F.col("child").alias("node_id"), F.col("node").alias("parent_id"), "title",
                                               F.col("clvl").alias("level"), F.lit(None).cast("string").alias("url")))
        going = here.where("goes_on").join(child.select("site", "node", "key", "child", "clvl"), ["site", "node", "key"])
        state = cut_lineage(going.select("site", "url", "own_title", "dirs", F.col("child").alias("node"), F.col("clvl").alias("lvl")))
        depth += 1
        if state.isEmpty():
            break
    out = added[0]
    for part in added[1:]:
        out = out.unionByName(part)
    return out
