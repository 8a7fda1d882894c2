"""Dense numbering, the target index and healing against sequential versions."""

import random

from pyspark.sql import functions as F

from sitequill.operators import library as LB
from sitequill.operators import tree as TR
from sitequill.operators.scan import dense_number


def test_numbers_are_those_of_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.randint(0, 400), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, i int").repartition(7)
    got = dense_number(df, ["k", "i"], "n", "g").collect()
    by = {}
    for g, k, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        by.setdefault(g, []).append(i)
    assert {(r.g, r.i): r.n for r in got} == {(g, i): n for g, own in by.items() for n, i in enumerate(own)}
    whole = dense_number(df, [F.desc("k"), "i"], "n", start=1).collect()
    assert [r.i for r in sorted(whole, key=lambda r: r.n)] == [i for _, _, i in sorted(rows, key=lambda r: (-r[1], r[2]))]
    assert sorted(r.n for r in whole) == list(range(1, 3001))
    equal = dense_number(spark.range(500).select(F.lit("x").alias("g"), F.lit(1).alias("k")), ["k"], "n", "g").collect()
    assert sorted(r.n for r in equal) == list(range(500))
    assert dense_number(df.where("false"), ["k"], "n", "g").collect() == []


def test_targets_in_any_place(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab# é") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["FootNotes2", "Notes", "", None, "Notes"]
    targets = ["".join(rng.choice("ab# éz") for _ in range(rng.randint(0, 7))) for _ in range(150)] + ["Notes", "Notes", "ote", None, "N", "", "notes"]
    got = LB.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in targets], "target string"))
    want = {(x, t) for x in texts for t in targets if x is not None and t is not None and t in x}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = spark.createDataFrame([], "target string")
    assert LB.containing(spark.createDataFrame([("a",)], "text string"), none).collect() == []


def test_many_targets_without_nested_loops(spark):
    heads = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("site"), F.col("id").alias("line_no"), F.concat(F.lit("# Title number "), F.col("id"), F.lit(" end")).alias("text"))
    targets = spark.range(100_000).select(F.concat(F.lit("number "), F.col("id"), F.lit(" ")).alias("target"))
    got = LB.target_heading_audit(heads, targets)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert got.count() == 3000


def healed_one_by_one(tree, missing, crumbs):
    """The pass as written down: URL by URL, first child of a title wins."""
    kids = {}
    level = {"0": 0}
    for node_id, parent, title, lvl, _, _ in sorted(tree, key=lambda r: r[5]):
        kids.setdefault(str(parent), []).append((title, str(node_id)))
        level[str(node_id)] = lvl
    out = []

    def add(node_id, parent, title, url):
        kids.setdefault(parent, []).append((title, node_id))
        level[node_id] = level[parent] + 1
        out.append((node_id, parent, title, level[node_id], url))

    for url in sorted(missing):
        cr, page_title = list(crumbs[url][0]), crumbs[url][1]
        if not cr:
            add("page:" + url, "0", page_title, url)
            continue
        if cr[0].lower() in ("home", "docs", "documentation root"):
            cr.pop(0)
        own = cr.pop() if cr else "Untitled"
        node = "0"
        for seg in cr:
            found = next((c for t, c in kids.get(node, []) if t is not None and t.lower() == seg.lower()), None)
            if found is None:
                found = (node if node.startswith("dir:") else "dir:" + node) + "/" + seg.lower()
                add(found, node, seg, None)
            node = found
        add("page:" + url, node, own, url)
    return sorted(out, key=str)


def test_healing_equals_the_sequential_pass(spark):
    under_pages = 0
    for seed in range(4):
        rng = random.Random(seed)
        names = ["New", "new", "Other", "More", "Alpha", "alpha", "Beta", "BETA", "Gamma", "Home", "docs"]
        tree = [(i, rng.randint(0, i - 1), rng.choice(names), 0, None, i) for i in range(1, 12)]
        levels = {0: 0}
        for j, (i, p, t, _, u, s) in enumerate(tree):
            levels[i] = levels[p] + 1
            tree[j] = (i, p, t, levels[i], u, s)
        missing = [f"https://e.org/{rng.randint(0, 10**6)}" for _ in range(40)]
        crumbs = {u: ([rng.choice(names) for _ in range(rng.randint(0, 5))], rng.choice([*names, "Page"])) for u in missing}
        got = TR.heal_tree(
            spark.createDataFrame([("e.org", *r) for r in tree], "site string, node_id int, parent_id int, title string, level int, url string, sib_ord int"),
            spark.createDataFrame([("e.org", u) for u in set(missing)], "site string, url string"),
            spark.createDataFrame([("e.org", u, *c) for u, c in crumbs.items()], "site string, url string, crumbs array<string>, page_title string"))
        mine = sorted((tuple(r)[1:] for r in got.collect()), key=str)
        assert mine == healed_one_by_one(tree, set(missing), crumbs)
        under_pages += sum(p.startswith("page:") for _, p, *_ in mine)
    assert under_pages > 0
