"""Discovery fusion, native-Markdown probing and page-body selection.

Every merge is an aggregate keyed by (site, key) with ``min_by`` over a
priority struct: a hash aggregate with map-side partials, so a hot key is
combined before the shuffle. Orders stay as sort keys (``ord``, ``url``); no
site-wide dense numbering is materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as TX
from ..functions import urls as U
from .scan import dense_number
from ..session import cut_lineage
from . import extract as X

# Order offsets of fused sources, strategy priority, titles to repair.
SITEMAP_ORDER_BASE = 9999
HEURISTIC_ORDER_BASE = 20000
SOURCE_PRIORITY = {"sidebar": 1, "sitemap": 2, "heuristic": 3}
STRATEGY_PRIORITY = ["github", "sitemap", "scraping"]
TITLES_TO_REPAIR = ["Untitled", "Native Page", "Introduction"]

# Python's str.splitlines() boundaries.
SPLITLINES_RE = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def entry_pages(pages: DataFrame) -> DataFrame:
    """The page a site is entered from: shortest, then smallest canonical URL.

    (site, page_id, url, base_url). A ``min_by`` aggregate per site.
    """
    k = pages.select("page_id", "url", U.site_of("url").alias("site"), U.canonical_url("url").alias("ckey"))
    best = k.groupBy("site").agg(F.min_by(F.struct("page_id", "url"), F.struct(F.length("ckey"), "ckey", "page_id")).alias("e"))
    return best.select("site", "e.page_id", "e.url", U.site_root("e.url").alias("base_url"))


def urls_to_nodes(urls: DataFrame, base_col: str = "base_url") -> DataFrame:
    """Distinct URLs -> (site, url, title, depth, parent=null); depth counts
    path segments below the base path."""
    d = urls.select("site", "url", base_col).distinct()
    return d.select(
        "site", "url",
        U.title_from_url("url").alias("title"),
        U.depth_from_path("url", U.base_depth_of(base_col)).alias("depth"),
        F.lit(None).cast("string").alias("parent"),
    )


def fuse_sources(sidebar: DataFrame, sitemap_urls: DataFrame, heuristic: DataFrame, bases: DataFrame) -> DataFrame:
    """Merge discovery sources per canonical URL: sidebar, else sitemap, else
    link scan. Sidebar entries sharing a canonical URL are last-wins (highest
    order); the other sources keep the smallest URL.

    sidebar(site, url, title, level, ord); sitemap_urls(site, url);
    heuristic(site, url, title, depth); bases(site, base_url).
    Returns (site, url, title, depth, ord, source).
    """
    sb = sidebar.select("site", "url", F.coalesce("title", F.lit("Untitled")).alias("title"),
                        F.coalesce("level", F.lit(0)).alias("depth"), F.coalesce("ord", F.lit(0)).alias("ord"),
                        F.lit("sidebar").alias("source"), F.lit(SOURCE_PRIORITY["sidebar"]).alias("prio"),
                        (-F.coalesce("ord", F.lit(0))).alias("tie"))
    sm = sitemap_urls.join(bases, "site").select(
        "site", "url", U.title_from_url("url").alias("title"),
        U.estimate_depth("url", "base_url").alias("depth"),
    ).select("site", "url", "title", "depth", (F.lit(SITEMAP_ORDER_BASE) + F.col("depth")).alias("ord"),
             F.lit("sitemap").alias("source"), F.lit(SOURCE_PRIORITY["sitemap"]).alias("prio"), F.lit(0).alias("tie"))
    hs = heuristic.select("site", "url", "title", "depth",
                          (F.lit(HEURISTIC_ORDER_BASE) + F.col("depth")).alias("ord"),
                          F.lit("heuristic").alias("source"), F.lit(SOURCE_PRIORITY["heuristic"]).alias("prio"),
                          F.lit(0).alias("tie"))
    allsrc = sb.unionByName(sm).unionByName(hs).withColumn("ckey", U.canonical_url("url"))
    best = allsrc.groupBy("site", "ckey").agg(
        F.min_by(F.struct("url", "title", "depth", "ord", "source"), F.struct("prio", "tie", "url")).alias("n"))
    return best.select("site", "n.url", "n.title", "n.depth", "n.ord", "n.source")


def order_fused(fused: DataFrame) -> DataFrame:
    """Fused nodes with ``node_order``, their place in their site's reading
    order: by the order their source gave them, then by URL."""
    return dense_number(fused, ["ord", "url"], "node_order", "site")


def order_urls(urls: DataFrame) -> DataFrame:
    """Distinct (site, url) with ``node_order``, their place in their site by URL."""
    return dense_number(urls.select("site", "url").distinct(), ["url"], "node_order", "site")


def discovery_counts(sidebar: DataFrame, sitemap_urls: DataFrame, heuristic: DataFrame, fused: DataFrame) -> DataFrame:
    """Rows per discovery source and the merged count, per site."""
    u = (sidebar.select("site", F.lit("sidebar").alias("source"))
         .unionByName(sitemap_urls.select("site", F.lit("sitemap").alias("source")))
         .unionByName(heuristic.select("site", F.lit("heuristic").alias("source"))))
    per = u.groupBy("site").pivot("source", ["sidebar", "sitemap", "heuristic"]).count().na.fill(0)
    merged = fused.groupBy("site").agg(F.count("*").alias("merged"))
    return per.join(merged, "site", "full").na.fill(0)


def probe_resolve(urls: DataFrame, fetches: DataFrame) -> DataFrame:
    """Native Markdown per URL: the lowest-rank candidate that answered 200
    with a body not starting ``<!doctype html``. An accepted empty body ends
    the search without a hit. (site, url, cand_rank, content)."""
    cands = urls.select("site", "url", F.inline(U.md_candidates("url")))
    # Every candidate URL ends in ".md": other responses can never match.
    ok = fetches.where((F.col("status") == 200) & F.col("url").endswith(".md") & P.looks_like_markdown("body")).select(
        "site", F.col("url").alias("cand_url"), "body")
    hits = cands.join(ok, ["site", "cand_url"])
    first = hits.groupBy("site", "url").agg(F.min_by(F.struct("cand_rank", "body"), F.struct("cand_rank", "body")).alias("h"))
    return first.where(F.col("h.body") != "").select("site", "url", "h.cand_rank", F.col("h.body").alias("content"))


def probe_hit_rate(urls: DataFrame, hits: DataFrame) -> DataFrame:
    """hits / probed * 100 per site (0 when nothing was probed)."""
    n = urls.groupBy("site").agg(F.count("*").alias("probed"))
    h = hits.groupBy("site").agg(F.count("*").alias("hits"))
    j = n.join(h, "site", "left").na.fill(0, ["hits"])
    return j.select("site", "probed", "hits",
                    F.when(F.col("probed") > 0, F.col("hits") * 100.0 / F.col("probed")).otherwise(F.lit(0.0)).alias("hit_rate"))


def remaining_urls(urls: DataFrame, hits: DataFrame) -> DataFrame:
    """URLs whose normalized form has no native hit (left anti join)."""
    hk = hits.select("site", U.normalize_url("url").alias("nkey")).distinct()
    return urls.withColumn("nkey", U.normalize_url("url")).join(hk, ["site", "nkey"], "left_anti").drop("nkey")


def repair_title(title, content) -> F.Column:
    """Replace a placeholder or blank title by the first ``# `` or ``title:``
    line among the first 20 lines of the content."""
    lines = F.slice(F.split(content, SPLITLINES_RE, -1), 1, 20)
    stripped = F.transform(lines, lambda l: TX.py_strip(l))
    cand = F.try_element_at(F.filter(stripped, lambda l: l.startswith("# ") | l.startswith("title: ")), F.lit(1))
    fixed = F.when(cand.startswith("# "), TX.py_strip(F.substring(cand, 3, 1 << 30))).otherwise(
        F.trim(F.trim(TX.py_strip(F.substring(cand, 8, 1 << 30)), F.lit('"')), F.lit("'")))
    t = F.col(title) if isinstance(title, str) else title
    needs = t.isin(*TITLES_TO_REPAIR) | t.isNull() | (t == "")
    return F.when(needs & cand.isNotNull(), fixed).otherwise(t)


def native_pages(hits: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Probe hits as page records, titled from the hierarchy (default
    ``Untitled``) and repaired from the content. (site, url, title, content, source)."""
    h = hierarchy.select("site", "url", F.col("title").alias("h_title"))
    j = hits.join(h, ["site", "url"], "left")
    t = F.coalesce("h_title", F.lit("Untitled"))
    return j.select("site", "url", repair_title(t, F.col("content")).alias("title"), "content",
                    F.lit("native_probe").alias("source"))


def captured_bodies(urls: DataFrame, captures: DataFrame) -> DataFrame:
    """One captured body per URL: (site, url, body).

    urls(site, url), captures(site, url, body). A capture belongs to a URL if
    their canonical forms agree, so ``/p/`` or ``/p?utm=x`` serves ``/p``; the
    same spelling is preferred, then the smallest one, and of several bodies
    captured under one spelling the one of the smallest hash. The choice is
    made on thin rows; bodies are shuffled once, by what was chosen.
    """
    mark = F.xxhash64("body")
    thin = captures.select("site", F.col("url").alias("c_url"), mark.alias("c_mark"), U.canonical_url("url").alias("ckey"))
    wanted = urls.select("site", "url", U.canonical_url("url").alias("ckey")).distinct()
    rank = F.struct((F.col("url") != F.col("c_url")).alias("other"), "c_url", "c_mark")
    best = wanted.join(thin, ["site", "ckey"]).groupBy("site", "url").agg(F.min(rank).alias("b"))
    best = best.select(F.col("site").alias("b_site"), F.col("url").alias("for_url"), F.col("b.c_url").alias("c_url"), F.col("b.c_mark").alias("c_mark"))
    bodies = captures.select("site", "url", mark.alias("mark"), "body")
    found = bodies.join(best, (F.col("site") == F.col("b_site")) & (F.col("url") == F.col("c_url")) & (F.col("mark") == F.col("c_mark")))
    # Equal captures give one row; the join has already dealt out by these keys.
    return found.groupBy("site", "url", "mark", "for_url").agg(F.first("body").alias("body")).select("site", F.col("for_url").alias("url"), "body")


def _md_body_rows(url, body):
    yield body, X.extract_title(body)


def _html_body_rows(url, body):
    yield X.page_text(body), X.extract_title(body)


def body_fallback(urls: DataFrame, fetches: DataFrame) -> DataFrame:
    """Sitemap strategy page bodies: ``<url>.md`` if it answered 200, else the
    HTML page's main text (dropped when empty). Titles from the body, else the
    URL. (site, url, title, content, source).

    One Python pass per body kind; site, URLs and fallback titles ride along.
    """
    ok = fetches.where(F.col("status") == 200)
    u = urls.select("site", "url").distinct().withColumn("md", U.md_url("url"))
    ok_md = ok.where(F.col("url").endswith(".md")).select(F.col("site").alias("f_site"), F.col("url").alias("f_url"), "body")
    md = (u.join(ok_md, (F.col("site") == F.col("f_site")) & (F.col("md") == F.col("f_url")))
          .groupBy("site", "url", F.col("md").alias("page_url")).agg(F.min("body").alias("body")))
    rest = u.join(md.select("site", "url"), ["site", "url"], "left_anti")
    html = captured_bodies(rest.select("site", "url"), ok.where(~F.col("url").endswith(".md")).select("site", "url", "body"))
    fallback = U.title_from_url("url", keep_underscore=True).alias("fallback_title")
    md_in = md.select("site", "page_url", "body", fallback)
    html_in = html.select("site", F.col("url").alias("page_url"), "body", fallback)
    out = "content string, title string"
    md_pages = X.map_pages(md_in, _md_body_rows, out, id_col="site", url_col="page_url", html_col="body",
                           keep_url=True, carry=["fallback_title"]).withColumn("source", F.lit("sitemap-md"))
    html_pages = (X.map_pages(html_in, _html_body_rows, out, id_col="site", url_col="page_url", html_col="body",
                              keep_url=True, carry=["fallback_title"])
                  .where(F.col("content") != "").withColumn("source", F.lit("sitemap-html")))
    both = md_pages.unionByName(html_pages)
    return both.select(
        "site", F.col("page_url").alias("url"),
        F.when(F.col("title").isNull() | (F.col("title") == ""), F.col("fallback_title")).otherwise(F.col("title")).alias("title"),
        "content", "source")


def strategy_fallback(candidates: DataFrame) -> DataFrame:
    """Per site keep every page of the first strategy (github, sitemap,
    scraping) that produced at least one page. candidates(site, strategy, ...)."""
    prio = F.array_position(F.array(*[F.lit(s) for s in STRATEGY_PRIORITY]), F.col("strategy"))
    # Used twice (winner per site, then the winner's pages): computed once.
    c = cut_lineage(candidates.withColumn("_prio", prio))
    win = c.groupBy("site").agg(F.min("_prio").alias("_prio"))
    return c.join(win, ["site", "_prio"], "left_semi").drop("_prio")
