"""Filters and the image-link rewrite against tables of inputs and expected values."""

from pyspark.sql import functions as F

from sitequill.functions import predicates as P
from sitequill.operators import assets as A

PREDICATES = [
    # url, valid page of h.example, blocked link, asset, kept by 'DOCS' without '/x' and 'api'
    ('https://h.example/docs/page', True, False, False, True),
    ('https://h.example/search?q=1', False, False, False, False),
    ('https://h.example/API/v1', False, False, False, False),
    ('https://h.example/a/style.CSS', False, False, False, False),
    ('https://h.example/img/x.png', False, False, True, False),
    ('https://other.example/docs', False, False, False, True),
    ('mailto:me@h.example', False, False, False, False),
    ('https://h.example/login/', False, True, False, False),
    ('https://h.example/sign/register-now', True, True, False, False),
    ('https://h.example/x.pdf#p2', True, False, True, False),
    ('https://h.example/file.tar.gz?dl=1', True, False, True, False),
    ('#top', False, False, False, False),
    ('', False, False, False, False),
    ('https://h.example/path/twitter.com/x', True, True, False, False),
    ('https://h.example/assets/logo.svg', False, False, True, False),
]


def test_url_predicates(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PREDICATES)], "i int, u string")
    rows = df.orderBy("i").select(
        "u", F.coalesce(P.valid_page_url(F.col("u"), F.lit("h.example")), F.lit(False)), P.link_blocked("u"), P.asset_extension("u"),
        P.include_exclude("u", "DOCS", " /x , ,api")).collect()
    assert [tuple(r) for r in rows] == PREDICATES


def test_case_sensitive_section(spark):
    df = spark.createDataFrame([(u,) for u in ("https://h/docs/a", "https://h/DOCS/a", "https://h/x")], "u string")
    assert [r.u for r in df.where(P.include_exclude("u", "docs", None, case_sensitive=True)).collect()] == ["https://h/docs/a"]
    assert [r.u for r in df.where(P.include_exclude("u", "docs", None)).collect()] == ["https://h/docs/a", "https://h/DOCS/a"]


CONTENT = [
    # content, title, looks like Markdown, enough content
    ("<!DOCTYPE html><p>", "t", False, True),
    ("  \n<!doctype HTML>", None, False, False),
    ("# Title", None, True, False),
    ("", "t", True, False),
    ("short", None, True, False),
    ("short", "T", True, True),
    ("x" * 51, None, True, True),
    ("   " + "y" * 50 + "  ", None, True, False),
]


def test_markdown_and_content_predicates(spark):
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _, _) in enumerate(CONTENT)], "i int, c string, t string")
    got = df.orderBy("i").select("c", "t", P.looks_like_markdown("c"), P.min_content(F.col("c"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == CONTENT


REWRITTEN = {
    "a ![logo](https://x.example/i/logo.PNG?v=2) b": "a ![logo](assets/logo.PNG) b",
    "![](rel/pic.jpg#frag) and ![doc](/f/readme.md)": "![](assets/pic.jpg) and ![doc](/f/readme.md)",
    "![x](https://x.example/) ![y](a.gif)": "![x](https://x.example/) ![y](assets/a.gif)",
    "text [link](a.png) ![z](d/e.svg)": "text [link](a.png) ![z](assets/e.svg)",
}


def test_rewrite_asset_links(spark):
    df = spark.createDataFrame([(t,) for t in REWRITTEN], "t string")
    assert {r.t: r.out for r in df.select("t", A.rewrite_asset_links(F.col("t")).alias("out")).collect()} == REWRITTEN
