"""Tree building (nested and flat layouts) and breadcrumb healing."""

from sitequill.operators import tree as TR
from sitequill.operators.htmltree import parse

NESTED = """<ul><li><a href="/a">A</a></li><li><div>Group</div></li><li><a href="/b">B</a></li>
<li><div>Folder</div><ul><li><a href="/c">C</a></li></ul></li><li><a href="/d">D</a></li></ul>"""

FLAT = """<div><ul>
<li><a class="x toclink" href="/one">One</a><div><ul><li><a class="toclink" href="/one/a">One A</a></li></ul></div></li>
<li><a class="toclink" href="/two">Two</a></li><li><a class="toclink" href="/three">Three</a></li>
<li><a class="toclink" href="/two#again">Two again</a></li></ul></div>"""


def test_nested_tree_sections():
    nodes = TR.build_tree(parse(NESTED), "https://h.example/")
    # A header without a list captures the following links; one with a list does not.
    assert [(n[0], n[1], n[2], n[3]) for n in nodes] == [
        (1, 0, "A", 1), (2, 0, "Group", 1), (3, 2, "B", 1), (4, 0, "Folder", 1), (5, 4, "C", 2), (6, 0, "D", 1)]


def test_flat_tree():
    root = parse(FLAT)
    assert TR.layout_kind(root) == ("flat", 5)
    nodes = TR.build_tree(root, "https://h.example/")
    assert [(n[1], n[2], n[3], n[4]) for n in nodes] == [
        (0, "One", 1, "https://h.example/one"), (1, "One A", 2, "https://h.example/one/a"),
        (0, "Two", 1, "https://h.example/two"), (0, "Three", 1, "https://h.example/three")]


def test_heal_tree(spark):
    tree = spark.createDataFrame([
        ("s", 1, 0, "Guides", 1, None, 0), ("s", 2, 1, "Setup", 2, "https://s/setup", 0)],
        "site string, node_id int, parent_id int, title string, level int, url string, sib_ord int")
    missing = spark.createDataFrame([("s", "https://s/guides/adv"), ("s", "https://s/other")], "site string, url string")
    crumbs = spark.createDataFrame([
        ("s", "https://s/guides/adv", ["Home", "guides", "Deep", "Advanced"], "Adv | S"),
        ("s", "https://s/other", [], "Other Page")], "site string, url string, crumbs array<string>, page_title string")
    got = sorted(tuple(r) for r in TR.heal_tree(tree, missing, crumbs).collect())
    assert got == sorted([
        ("s", "dir:1/deep", "1", "Deep", 2, None),
        ("s", "page:https://s/guides/adv", "dir:1/deep", "Advanced", 3, "https://s/guides/adv"),
        ("s", "page:https://s/other", "0", "Other Page", 1, "https://s/other"),
    ])


def test_heal_tree_golden_paths(spark):
    """Case-insensitive matches of existing directories, first sibling first;
    one new directory for a path that several pages share; dropped heads."""
    tree = spark.createDataFrame([
        ("s", 1, 0, "Guides", 1, None, 0), ("s", 2, 0, "guides", 1, None, 1), ("s", 3, 1, "API", 2, None, 0), ("t", 1, 0, "API", 1, None, 0)],
        "site string, node_id int, parent_id int, title string, level int, url string, sib_ord int")
    cases = [
        # url, crumbs, title, parent, level
        ("u1", ["GUIDES", "Page"], "T1", "1", 2),
        ("u2", ["Home", "Guides", "api", "Page"], "T2", "3", 3),
        ("u3", ["Guides", "New", "Deep", "Page"], "T3", "dir:1/new/deep", 4),
        ("u4", ["guides", "new", "deep", "Other"], "T4", "dir:1/new/deep", 4),
        ("u5", ["Docs"], "T5", "0", 1),
        ("u6", [], "T6", "0", 1),
        ("u7", ["Documentation Root", "API", "Page"], "T7", "dir:0/api", 2),
    ]
    missing = spark.createDataFrame([("s", c[0]) for c in cases], "site string, url string")
    crumbs = spark.createDataFrame([("s", c[0], c[1], c[2]) for c in cases], "site string, url string, crumbs array<string>, page_title string")
    out = {r.node_id: r for r in TR.heal_tree(tree, missing, crumbs).collect()}
    titles = {"u1": "Page", "u2": "Page", "u3": "Page", "u4": "Other", "u5": "Untitled", "u6": "T6", "u7": "Page"}
    for url, _, _, parent, level in cases:
        node = out.pop(f"page:{url}")
        assert (node.title, node.parent_id, node.level, node.url) == (titles[url], parent, level, url)
    assert {(r.node_id, r.parent_id, r.title.lower(), r.level) for r in out.values()} == {
        ("dir:1/new", "1", "new", 2), ("dir:1/new/deep", "dir:1/new", "deep", 3), ("dir:0/api", "0", "api", 1)}


def test_heal_tree_follows_deep_paths(spark):
    depth = 40
    rows = [("s", i, i - 1, f"D{i}", i, None, 0) for i in range(1, depth + 1)]
    tree = spark.createDataFrame(rows, "site string, node_id int, parent_id int, title string, level int, url string, sib_ord int")
    missing = spark.createDataFrame([("s", "u")], "site string, url string")
    crumbs = spark.createDataFrame([("s", "u", [f"d{i}" for i in range(1, depth + 1)] + ["Leaf"], "T")],
                                   "site string, url string, crumbs array<string>, page_title string")
    assert [tuple(r) for r in TR.heal_tree(tree, missing, crumbs).collect()] == [("s", "page:u", str(depth), "Leaf", depth + 1, "u")]


def test_deeply_nested_lists_and_blocks():
    from sitequill.operators import extract as X

    deep = "".join(f"<ul><li><a href='/{i}'>L{i}</a>" for i in range(3000))
    nodes = TR.build_tree(parse(deep), "https://h/")
    assert len(nodes) == 3000 and nodes[-1][:2] == (3000, 2999)
    assert len(X.sidebar_entries(parse("<aside>" + deep), "https://h/")) == 3000
    assert X.page_markdown("<main>" + "<div>" * 5000 + "in")[0] == "in"
