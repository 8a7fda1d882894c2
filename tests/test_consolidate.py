"""Heading re-levelling cases (target level 2), shipped and tested rules."""

import pytest
from pyspark.sql import functions as F

from sitequill.operators import consolidate as C

CASES = [
    ("## Sub Header\nText", "Main Page", "### Sub Header\nText", "### Sub Header\nText"),
    ("# Page SubTitle\nText", "Main Page", "### Page SubTitle\nText", "### Page SubTitle\nText"),
    ("# Mission\nOur mission is...", "Mission", "Our mission is...", "Our mission is..."),
    ("# The Mission\nText", "Mission", "Text", "Text"),
    ("# Mixed\n## Sub1\n### Sub2", "Mixed", "#### Sub1\n##### Sub2", "### Sub1\n#### Sub2"),
]


@pytest.mark.parametrize("tested", [False, True])
def test_heading_cases(spark, tested):
    df = spark.createDataFrame([(i, c, 2, t) for i, (c, t, _, _) in enumerate(CASES)],
                               "i int, content string, tgt int, title string")
    out = C.relevel(df, "content", "tgt", "title", "body", tested).orderBy("i").select("body").collect()
    want = [tr if tested else sh for _, _, sh, tr in CASES]
    assert [r[0] for r in out] == want


def test_no_headings_unchanged(spark):
    df = spark.createDataFrame([("  plain\n\n\n\n\ntext  ", 2, "T")], "content string, tgt int, title string")
    assert C.relevel(df, "content", "tgt", "title", "body").first()[0] == "  plain\n\n\n\n\ntext  "


def test_document_matches_python_concatenation(spark):
    """Blocks joined by one newline equal the whole-string construction."""
    pages = spark.createDataFrame([
        ("s", "https://s.example/a", "Alpha | S", "# Alpha\nbody a\n\n\n\n\n"),
        ("s", "https://s.example/b", "Beta", "## Part\nbody b"),
        ("s", "https://s.example/c", "Gamma", "body a\n\n\n\n\n".replace("body a", "# Alpha\nbody a")),
        ("s", "https://s.example/d", "Blank", "   "),
    ], "site string, url string, title string, content string")
    hier = spark.createDataFrame([
        ("s", "https://s.example/a", 1, 0, "Start"), ("s", "https://s.example/b", 2, 1, "Start"),
        ("s", "https://s.example/c", 1, 2, "Later"),
    ], "site string, url string, level int, ord int, section string")
    bases = spark.createDataFrame([("s", "https://s.example")], "site string, base_url string")
    blocks = C.consolidate(pages, hier, bases, "T0").orderBy("part", "k1", "k2").select("block").collect()
    doc = "\n".join(r[0] for r in blocks)
    assert doc.startswith("# S.Example\n\n")
    assert "**Pages:** 4  \n" in doc
    assert "\n## Start\n\n## Alpha\n\nbody a\n\n---\n" in doc
    assert "### Beta\n\n#### Part\nbody b" in doc
    assert "Gamma" not in doc            # same stripped content as Alpha: dropped
    assert "Blank" not in doc
    assert doc.endswith("---\n")


def test_heuristic_score(spark):
    df = spark.createDataFrame([("Getting Started 2", "https://x/a/b"), ("Intro", "https://x/a")], "title string, url string")
    got = [r[0] for r in df.select(C.heuristic_score(F.col("title"), F.col("url"))).collect()]
    assert [int(g) for g in got] == [1000 + 900 + 798 + 97 + 45, 1000 + 99 + 46]


def test_site_without_hierarchy_uses_heuristic_order(spark):
    pages = spark.createDataFrame([
        ("m", "https://m.example/b", "Beta", "b body"), ("m", "https://m.example/a", "Alpha", "a body"),
        ("h", "https://h.example/z/deep/page", "Zeta", "z body"), ("h", "https://h.example/intro", "Introduction", "i body"),
    ], "site string, url string, title string, content string")
    hier = spark.createDataFrame([("m", "https://m.example/b", 1, 0, None), ("m", "https://m.example/a", 1, 1, None)],
                                 "site string, url string, level int, ord int, section string")
    bases = spark.createDataFrame([("m", "https://m.example"), ("h", "https://h.example")], "site string, base_url string")
    blocks = C.consolidate(pages, hier, bases, "T0").where("part = 1").orderBy("site", "k1", "k2").collect()
    order = {}
    for r in blocks:
        order.setdefault(r.site, []).append(r.block.split("\n", 1)[0])
    assert order["m"] == ["## Beta", "## Alpha"]                 # sidebar order
    assert order["h"] == ["## Introduction", "## Zeta"]          # no hierarchy: intro words first


def test_sink_splits_a_site_over_ordered_part_files(spark, tmp_path):
    import glob
    import os

    pages = spark.createDataFrame(
        [("big", f"https://big.example/p{i:03d}", f"Page {i}", f"# H{i}\nbody {i}\n") for i in range(60)]
        + [("small", "https://small.example/x", "X", "x body")],
        "site string, url string, title string, content string")
    hier = spark.createDataFrame([("big", f"https://big.example/p{i:03d}", 1, 60 - i, None) for i in range(60)],
                                 "site string, url string, level int, ord int, section string")
    bases = spark.createDataFrame([("big", "https://big.example"), ("small", "https://small.example")],
                                  "site string, base_url string")
    blocks = C.consolidate(pages, hier, bases, "T0")
    want = {}
    for r in blocks.orderBy("site", "part", "k1", "k2").collect():
        want.setdefault(r.site, []).append(r.block)
    out = str(tmp_path / "docs")
    C.sink_documents(blocks, out, n_partitions=6)
    big_parts = sorted(glob.glob(os.path.join(out, "site=big", "part-*")))
    assert len(big_parts) > 1                      # the hot site spans several files
    for site, bl in want.items():
        files = sorted(glob.glob(os.path.join(out, f"site={site}", "part-*")))
        text = "".join(open(f, encoding="utf-8").read() for f in files)
        assert text == "\n".join(bl)               # files in name order = the document
