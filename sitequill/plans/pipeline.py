"""End-to-end site pipeline: discovery fusion -> probe -> page bodies ->
consolidated documents, for every site at once.

The stages are lazy DataFrames; Catalyst plans the whole. Shuffles happen on
(site, canonical URL) for fusion, (site, url) for probing and body selection,
and (site, md5) for de-duplication. Python runs only in the HTML extraction
passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import consolidate as C
from ..operators import extract as X
from ..operators import fusion as FU
from ..operators import links as L
from ..operators import sitemaps as SM
from ..session import cut_lineage


@dataclass
class SiteOptions:
    section_path: str | None = None
    exclude_path: str | None = None
    downloaded: str = "1970-01-01 00:00:00 UTC"
    tested_rule: bool = False


@dataclass
class Discovery:
    """What was found for every site: the three sources, their merged nodes
    and the entry pages. Each is written once; several readers follow."""

    sidebar: DataFrame
    sitemap: DataFrame
    heuristic: DataFrame
    fused: DataFrame
    entry: DataFrame

    def counts(self) -> DataFrame:
        return FU.discovery_counts(self.sidebar, self.sitemap, self.heuristic, self.fused)


def discover(pages: DataFrame, fetches: DataFrame) -> Discovery:
    """Sidebar, sitemap and link-scan nodes of every site, merged."""
    entry = cut_lineage(FU.entry_pages(pages.select("page_id", "url")))
    # One page per site, written once: sidebar and links both read it.
    entry_html = cut_lineage(pages.join(entry.select("page_id"), "page_id", "left_semi"))
    sidebar = cut_lineage(X.sidebar_hierarchy_rows(entry_html).join(entry.select("page_id", "site"), "page_id").select(
        "site", "url", "title", "level", "ord", "section"))
    smap = cut_lineage(SM.resolve_sitemap_index(fetches, SM.scan_sitemaps(fetches).select("site", "url")))
    edges = L.link_edges(entry_html)
    heur = cut_lineage(FU.urls_to_nodes(edges.join(entry.select("site", "base_url"), "site")
                                        .select("site", F.col("to_url").alias("url"), "base_url"))
                       .select("site", "url", "title", "depth"))
    fused = cut_lineage(FU.fuse_sources(sidebar, smap, heur, entry.select("site", "base_url")))
    return Discovery(sidebar, smap, heur, fused, entry)


def site_documents(pages: DataFrame, fetches: DataFrame, opts: SiteOptions | None = None, found: Discovery | None = None) -> DataFrame:
    """Consolidated document blocks per site (see ``consolidate.consolidate``)."""
    opts = opts or SiteOptions()
    found = found or discover(pages, fetches)
    fused, entry = found.fused, found.entry
    urls = fused.where(P.include_exclude("url", opts.section_path, opts.exclude_path)).select("site", "url", "title")
    hits = FU.probe_resolve(urls.select("site", "url"), fetches)
    native = FU.native_pages(hits, urls).select("site", "url", "title", "content")
    rest = FU.remaining_urls(urls, hits)
    captures = fetches.where((F.col("status") == 200) & (F.col("kind") == "html")).select("site", "url", "body")
    # Remaining pages come from rendered captures: kept when the main content is
    # non-empty, titled by the content's h1, else by the document title.
    todo = FU.captured_bodies(rest.select("site", "url"), captures).select("site", "url", F.col("body").alias("html"))
    md = X.map_pages(todo, X.rendered_page_rows, "content string, h1_title string, doc_title string",
                     id_col="site", keep_url=True)
    scraped = md.where(F.col("content") != "").select(
        "site", "url",
        F.when(F.coalesce(F.col("h1_title"), F.lit("")) != "", F.col("h1_title")).otherwise(F.col("doc_title")).alias("title"),
        "content")
    site_pages = cut_lineage(native.unionByName(scraped))
    hierarchy = fused.select("site", "url", F.col("depth").alias("level"), "ord",
                             F.lit(None).cast("string").alias("section"))
    bases = entry.select("site", "base_url")
    return C.consolidate(site_pages, hierarchy, bases, opts.downloaded, opts.section_path, opts.tested_rule)


def rendered_documents(nodes: DataFrame, bases: DataFrame, fetches: DataFrame, opts: SiteOptions | None = None) -> DataFrame:
    """Documents of sites whose pages are listed by ``nodes`` (site, url, level,
    ord, section): each URL that the filters keep is read from its rendered
    capture, and the nodes give the reading order, levels and sections."""
    opts = opts or SiteOptions()
    urls = nodes.where(P.include_exclude("url", opts.section_path, opts.exclude_path)).select("site", "url").distinct()
    captures = fetches.where((F.col("status") == 200) & (F.col("kind") == "html")).select("site", "url", "body")
    todo = FU.captured_bodies(urls, captures).select("site", "url", F.col("body").alias("html"))
    md = X.map_pages(todo, X.rendered_page_rows, "content string, h1_title string, doc_title string", id_col="site", keep_url=True)
    title = F.when(F.coalesce(F.col("h1_title"), F.lit("")) != "", F.col("h1_title")).otherwise(F.col("doc_title"))
    pages = cut_lineage(md.where(F.col("content") != "").select("site", "url", title.alias("title"), "content"))
    return C.consolidate(pages, nodes.select("site", "url", "level", "ord", "section"), bases, opts.downloaded, opts.section_path, opts.tested_rule)


def sidebar_documents(pages: DataFrame, fetches: DataFrame, opts: SiteOptions | None = None, found: Discovery | None = None) -> DataFrame:
    """The sidebar flow: a site's pages are those of its entry page's sidebar,
    in its order, with its levels and sections. Sites without one have none."""
    found = found or discover(pages, fetches)
    return rendered_documents(found.sidebar, found.entry.select("site", "base_url"), fetches, opts)


def universal_nodes(found: Discovery) -> DataFrame:
    """(site, url, level, ord, section): a site's sitemap URLs, or, where there
    are none, the links of its entry page; by name, with their path's depth."""
    bases = found.entry.select("site", "base_url")
    listed = FU.urls_to_nodes(found.sitemap.join(bases, "site")).select("site", "url", "depth")
    linked = found.heuristic.select("site", "url", "depth").join(found.sitemap.select("site").distinct(), "site", "left_anti")
    ordered = FU.order_urls(listed.unionByName(linked))
    depths = listed.unionByName(linked).distinct()
    return depths.join(ordered, ["site", "url"]).select(
        "site", "url", F.col("depth").alias("level"), F.col("node_order").alias("ord"), F.lit(None).cast("string").alias("section"))


def universal_documents(pages: DataFrame, fetches: DataFrame, opts: SiteOptions | None = None, found: Discovery | None = None) -> DataFrame:
    """The universal flow: ``universal_nodes`` from their rendered captures."""
    found = found or discover(pages, fetches)
    return rendered_documents(universal_nodes(found), found.entry.select("site", "base_url"), fetches, opts)


#: Flows by the name the command line knows them by.
FLOWS = {"fusion": site_documents, "sidebar": sidebar_documents, "universal": universal_documents}


def scan_diagnostics(entry_html: DataFrame) -> DataFrame:
    """Per site, of its entry page (site, page_id, url, html): anchors in all,
    distinct links left by the filters, and the method."""
    total = X.anchors(entry_html).groupBy("page_id").agg(F.count("*").alias("total_links"))
    kept = L.link_edges(entry_html).groupBy("page_id").agg(F.count("*").alias("filtered_links"))
    per = entry_html.select("site", "page_id").join(total, "page_id", "left").join(kept, "page_id", "left")
    return per.select("site", F.coalesce("total_links", F.lit(0)).alias("total_links"), F.coalesce("filtered_links", F.lit(0)).alias("filtered_links"),
                      F.lit("heuristic_dom").alias("method"))


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """Diagnostics (discovery counts, scan diagnostics, run statistics) as JSON
    lines, one file set per site under ``site=<site>/``."""
    diagnostics.write.mode("overwrite").partitionBy("site").json(path)


def run_stats(documents: DataFrame, assets: DataFrame | None, duration_sec: float) -> DataFrame:
    """Per site: pages, assets, duration and pages / max(duration, 0.1)."""
    pages = documents.where(F.col("part") == 1).groupBy("site").agg(F.count("*").alias("pages_downloaded"))
    if assets is not None:
        a = assets.groupBy("site").agg(F.count_distinct("asset_url").alias("assets_downloaded"))
        pages = pages.join(a, "site", "left").na.fill(0, ["assets_downloaded"])
    else:
        pages = pages.withColumn("assets_downloaded", F.lit(0).cast("long"))
    d = float(duration_sec)
    return pages.select("site", "pages_downloaded", "assets_downloaded", F.lit(d).alias("duration"),
                        (F.col("pages_downloaded") / F.lit(max(d, 0.1))).alias("pages_per_second"))


__all__ = ["FLOWS", "Discovery", "SiteOptions", "discover", "rendered_documents", "run_stats", "scan_diagnostics", "sidebar_documents",
           "site_documents", "universal_documents", "universal_nodes", "write_diagnostics"]
