"""Distributed ordered scan, repository scan, and the driver contract."""

import pandas as pd

import __spark_entry__ as E
from sitequill.operators.scan import exclusive_running_sum
from sitequill.sources.markdown_files import scan_markdown_corpus


def test_exclusive_running_sum_matches_pandas(spark):
    rows = [("big" if i % 3 else f"s{i % 5}", i, (i * 7) % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v long")
    got = exclusive_running_sum(df, "g", ["k"], "v", "before", n_partitions=6).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "k", "v"]).sort_values(["g", "k"])
    pdf["before"] = pdf.groupby("g")["v"].cumsum() - pdf["v"]
    m = got.merge(pdf, on=["g", "k"], suffixes=("", "_want"))
    assert len(m) == 400 and (m["before"] == m["before_want"]).all()


def test_markdown_corpus_scan(spark, tmp_path):
    (tmp_path / "docs" / "guide").mkdir(parents=True)
    (tmp_path / "docs" / "guide" / "getting-started.md").write_text("intro line\n# Getting Started\nbody")
    (tmp_path / "docs" / "api_ref.md").write_text("no title here")
    (tmp_path / "docs" / "notes.txt").write_text("# not markdown")
    df = scan_markdown_corpus(spark, str(tmp_path), "docs")
    got = sorted((r.path, r.title) for r in df.collect())
    assert got == [("docs/api_ref.md", "Api Ref"), ("docs/guide/getting-started.md", "Getting Started")]
    assert scan_markdown_corpus(spark, str(tmp_path), "missing").count() == 0


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    code = "import __spark_entry__ as E; print(len(E.queries()) >= len(E.oracle_sql()) > 60)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.strip() == "True"


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["site", "part", "k1", "k2", "block"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_oracles_small(spark):
    """A sample of queries against their DuckDB oracles at sf0.001."""
    import duckdb

    from scripts.check_oracles import rows_of
    from sitequill.sources.tables import TABLES, table_path
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    for name in ["url_keys", "link_edges", "page_markdown", "consolidated_document", "fuse_sources",
                 "probe_resolve", "asset_inventory", "task_state", "heading_audit"]:
        df = E.queries()[name](spark, sf)
        res = con.execute(E.oracle_sql()[name])
        dcols = [d[0] for d in res.description]
        assert sorted(df.columns) == sorted(dcols), name
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall()), name


def test_neighbor_value_matches_pandas(spark):
    from sitequill.operators.scan import neighbor_value
    rows = [("big" if i % 4 else f"s{i % 3}", i, f"v{(i * 13) % 17}") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, v string")
    pdf = pd.DataFrame(rows, columns=["g", "k", "v"]).sort_values(["g", "k"])
    pdf["prev"] = pdf.groupby("g")["v"].shift(1)
    pdf["next"] = pdf.groupby("g")["v"].shift(-1)
    for d in ("prev", "next"):
        got = neighbor_value(df, "g", ["k"], "v", "out", direction=d, n_partitions=5).toPandas()
        m = got.merge(pdf, on=["g", "k"])
        assert len(m) == 300
        assert (m["out"].fillna("<none>") == m[d].fillna("<none>")).all(), d


def test_write_diagnostics(spark, tmp_path):
    from sitequill.plans.pipeline import write_diagnostics
    df = spark.createDataFrame([("a", 3, 5), ("b", 1, 1)], "site string, sidebar long, merged long")
    write_diagnostics(df, str(tmp_path / "diag"))
    back = spark.read.json(str(tmp_path / "diag"))
    assert sorted((r.site, r.merged) for r in back.collect()) == [("a", 5), ("b", 1)]


def test_cli_run_writes_documents(spark, tmp_path):
    from sitequill.cli import run
    out = str(tmp_path / "out")
    run(spark, "/root/testdata/sf0.001/pages.parquet", out, section="en", exclude="/de/", downloaded="T")
    docs = spark.read.text(f"{out}/documents", wholetext=True)
    assert docs.count() > 0
    one = docs.first()[0]
    assert "**Downloaded:** T" in one or one.startswith("\n")
    diag = spark.read.json(f"{out}/diagnostics")
    assert {"site", "pages_downloaded", "pages_per_second", "assets_downloaded", "sidebar", "sitemap", "heuristic", "merged"} <= set(diag.columns)
    assert diag.where("merged > 0").count() > 0


def _page(title, nav=(), body="Body text of the page that is long enough."):
    links = "".join(f"<li><a href='{u}'>{t}</a></li>" for u, t in nav)
    return f"<html><head><title>{title}</title></head><body><aside><ul>{links}</ul></aside><main><h1>{title}</h1><p>{body} {title}</p></main></body></html>"


def test_captures_under_other_spellings_are_used(spark):
    from sitequill.plans.pipeline import site_documents
    from sitequill.sources import fetches as FE

    nav = [("/", "Home"), ("/p1", "One"), ("/p2", "Two"), ("/p3", "Three")]
    urls = ["https://h.example/", "https://h.example/p1/", "https://h.example/p2?utm=x", "https://h.example/p3", "https://h.example/p3/"]
    rows = [(i, u, _page(f"T{i}", nav)) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    fetches = FE.html_fetches(pages).unionByName(FE.sitemap_fetches(pages.where("page_id = 0").select("url")))
    blocks = [r.block for r in site_documents(pages, fetches).where("part = 1").collect()]
    # One page for each canonical URL; of the two spellings of /p3 the linked one.
    assert sorted(t for b in blocks for t in ("T0", "T1", "T2", "T3", "T4") if f"page that is long enough. {t}" in b) == ["T0", "T1", "T2", "T3"]


def test_captured_bodies_prefer_the_same_spelling(spark):
    from sitequill.operators.fusion import captured_bodies

    urls = spark.createDataFrame([("h", "https://h/a"), ("h", "https://h/b"), ("h", "https://h/none")], "site string, url string")
    caps = spark.createDataFrame([("h", "https://h/a/", "slash"), ("h", "https://h/a", "same"), ("h", "https://h/a", "same"),
                                  ("h", "https://www.h/b#x", "other")], "site string, url string, body string")
    assert sorted(tuple(r) for r in captured_bodies(urls, caps).collect()) == [("h", "https://h/a", "same"), ("h", "https://h/b", "other")]


def test_no_page_body_moves_on_site_alone(spark):
    from sitequill.operators import consolidate as C

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame([("s", f"u{i}", f"t{i}", f"c{i % 3}") for i in range(9)] + [("t", "u.md", "x", "c0"), ("s", "u1", "t1", "c1")],
                                      "site string, url string, title string, content string")
        hier = spark.createDataFrame([("s", "u4", 1, 0, None), ("t", "u", 2, 5, "Sec")], "site string, url string, level int, ord int, section string")
        kept = C.kept_pages(pages, hier)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert not __import__("re").search(r"hashpartitioning\(site#\d+, \d+\)", plan)
        assert {(r.site, r.url) for r in kept.collect()} == {("s", "u4"), ("s", "u0"), ("s", "u2"), ("t", "u.md")}
        assert {r.url: r.content for r in C.attach_content(kept.where("site = 's'"), pages).collect()} == {"u4": "c1", "u0": "c0", "u2": "c2"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest

    from sitequill.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802 - Spark's name
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
