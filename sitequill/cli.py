"""Command line: consolidated documents for every site in a table of captured pages.

    python -m sitequill.cli --pages PAGES.parquet --out OUT_DIR [--fetches FETCHES.parquet]
                            [--section en] [--exclude "/legal,/blog"] [--downloaded "2024-01-01 00:00:00 UTC"]

``pages`` holds (page_id, url, html); ``fetches`` (site, url, status, body, kind)
adds native Markdown and sitemap responses; without it, each site's sitemap is
derived from its captured pages. Writes ``OUT_DIR/documents/site=<site>/`` (ordered part files)
and ``OUT_DIR/diagnostics/`` (JSON: pages, assets and rate of the run, nodes by discovery source).
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import urls as U
from .operators import assets as A
from .operators import consolidate as C
from .plans.pipeline import FLOWS, SiteOptions, discover, run_stats, scan_diagnostics, write_diagnostics
from .session import build_session, cut_lineage
from .sources import fetches as FE


def run(spark: SparkSession, pages_path: str, out_dir: str, fetches_path: str | None = None,
        section: str | None = None, exclude: str | None = None,
        downloaded: str = "1970-01-01 00:00:00 UTC", flow: str = "fusion") -> None:
    t0 = time.time()
    pages = spark.read.parquet(pages_path).select("page_id", "url", "html")
    fetches = FE.html_fetches(pages.select("url", "html"))
    if fetches_path:
        fetches = fetches.unionByName(spark.read.parquet(fetches_path).select("site", "url", "status", "body", "kind"))
    else:
        fetches = fetches.unionByName(FE.sitemap_fetches(pages.select("url")))
    opts = SiteOptions(section_path=section, exclude_path=exclude, downloaded=downloaded)
    found = discover(pages, fetches)
    blocks = cut_lineage(FLOWS[flow](pages, fetches, opts, found))
    C.sink_documents(blocks, f"{out_dir}/documents")
    assets = A.asset_refs(pages.select(U.site_of("url").alias("site"), "url", F.lit(None).cast("string").alias("content"), "html"))
    stats = run_stats(blocks, assets, time.time() - t0)
    entry_html = pages.join(found.entry.select("page_id", "site"), "page_id").select("site", "page_id", "url", "html")
    every = stats.join(found.counts(), "site", "left").join(scan_diagnostics(entry_html), "site", "left")
    write_diagnostics(every.withColumn("section", F.lit(section)).withColumn("flow", F.lit(flow)), f"{out_dir}/diagnostics")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="sitequill", description=__doc__.split("\n\n")[0])
    ap.add_argument("--pages", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--fetches")
    ap.add_argument("--section")
    ap.add_argument("--exclude")
    ap.add_argument("--flow", choices=sorted(FLOWS), default="fusion")
    ap.add_argument("--downloaded", default=time.strftime("%Y-%m-%d %H:%M:%S UTC", time.gmtime()))
    a = ap.parse_args(argv)
    spark = build_session()
    try:
        run(spark, a.pages, a.out, a.fetches, a.section, a.exclude, a.downloaded, a.flow)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
