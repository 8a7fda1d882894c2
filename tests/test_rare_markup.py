"""Queries whose markup the driver's pages lack (tables, repository links,
embedded JSON): Spark against the DuckDB oracles on a small fixture."""

import duckdb
import pandas as pd

import __spark_entry__ as E
from scripts.check_oracles import rows_of

PAGES = [
    (1, "https://docs.example/a",
     '<html><body><table><tr><th>Key</th><th>Value</th></tr><tr><td>a <b>1</b></td><td>x</td></tr></table>'
     '<p><a href="https://github.com/org/repo/blob/main/docs/a.md">Edit</a></p>'
     '<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"page": 1, "nav": []}}, '
     '"buildId": "b"}</script></body></html>'),
    (2, "https://docs.example/b",
     '<html><body><table><tr><td>only</td></tr><tr></tr></table><table><tr><td>t2</td></tr></table>'
     '<a href="https://github.com/org/other">no blob</a>'
     '<script type="application/json" id="cfg">{}</script></body></html>'),
    (3, "https://other.example/c", '<html><body><a href="https://github.com/x/y/blob/v1/r.md">src</a></body></html>'),
]


def test_rare_markup_queries(spark, tmp_path):
    sf = str(tmp_path)
    pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).to_parquet(f"{sf}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    for name in ["html_tables", "detect_repo", "embedded_json", "link_edges", "page_titles"]:
        df = E.queries()[name](spark, sf)
        res = con.execute(E.oracle_sql()[name])
        dcols = [d[0] for d in res.description]
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        want = rows_of(dcols, res.fetchall())
        assert got == want, name
        if name in ("html_tables", "detect_repo", "embedded_json"):
            assert got, name
