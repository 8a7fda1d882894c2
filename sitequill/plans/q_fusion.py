"""Discovery, probing and page-body queries over ``fetches`` derived from ``pages``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import urls as U
from ..operators import extract as X
from ..operators import fusion as FU
from ..operators import links as L
from ..operators import sitemaps as SM
from ..session import ensure_checkpoint_dir
from ..sources import fetches as FE
from ..sources import markdown_files as MF
from ..sources.rich_pages import RICH_HTML, rich_pages
from ..sources.tables import read_table
from . import duck as D
from .pipeline import discover
from .q_html import _ANCHORS, _BLOCK, _NAV, _md_oracle, decode
from .registry import query

NL = "chr(10)"


def _pages(spark, sf):
    return read_table(spark, sf, "pages", "page_id", "url", "html")


# -- SQL twins of the derived inputs ---------------------------------------------

_MD_BODY = (f"'# ' || regexp_extract(html, {D.q(FE.TITLE_TAG_RE)}, 1) || {NL} || {NL} || "
            f"regexp_replace(regexp_extract(html, {D.q(FE.ARTICLE_RE)}, 1), '<[^>]+>', ' ', 'g')")

MD_FETCH_SQL = f"""
md_src AS (
  SELECT url, html, regexp_extract(html, {D.q(FE.LANG_RE)}, 1) AS lang FROM pages
), md_fetch AS (
  SELECT {D.site_of('url')} AS site, {D.lookup_key('url')} || '.md' AS url,
         CASE WHEN lang = 'en' THEN {_MD_BODY} ELSE html END AS body
  FROM md_src WHERE lang IN ('en', 'de')
  UNION ALL
  SELECT {D.site_of('url')} AS site, {D.lookup_key('url')} || '/README.md' AS url, {_MD_BODY} AS body
  FROM md_src WHERE lang = 'de'
)"""

ENTRY_SQL = f"""
entry AS (
  SELECT site, page_id, url, {D.site_root('url')} AS base_url FROM (
    SELECT page_id, url, {D.site_of('url')} AS site, {D.canonical_url('url')} AS ckey FROM pages)
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY length(ckey), ckey, page_id) = 1
)"""

PROBE_SQL = f"""
urls AS (SELECT DISTINCT {D.site_of('url')} AS site, url FROM pages),
cands AS (
  SELECT site, url, 1 AS cand_rank, {D.lookup_key('url')} || '.md' AS cand_url FROM urls
  UNION ALL
  SELECT site, url, 2, {D.lookup_key('url')} || '/README.md' FROM urls WHERE NOT ends_with({D.lookup_key('url')}, '.md')
), firsthit AS (
  SELECT c.site, c.url, c.cand_rank, f.body FROM cands c JOIN md_fetch f ON f.site = c.site AND f.url = c.cand_url
  WHERE NOT starts_with(lower({D.py_strip('f.body')}), '<!doctype html')
  QUALIFY row_number() OVER (PARTITION BY c.site, c.url ORDER BY c.cand_rank, f.body) = 1
), hits AS (SELECT * FROM firsthit WHERE body <> '')"""


def _probe_inputs(spark, sf):
    pages = read_table(spark, sf, "pages", "url")
    fetches = FE.fetch_table(spark, sf, ("md",))
    urls = pages.select(U.site_of("url").alias("site"), "url").distinct()
    return urls, fetches


@query("probe_resolve", oracle=f"""
WITH {MD_FETCH_SQL}, {PROBE_SQL}
SELECT site, url, cand_rank, md5(body) AS content_md5 FROM hits""")
def probe_resolve(spark, sf):
    urls, fetches = _probe_inputs(spark, sf)
    hits = FU.probe_resolve(urls, fetches)
    return hits.select("site", "url", "cand_rank", F.md5("content").alias("content_md5"))


@query("probe_hit_rate", oracle=f"""
WITH {MD_FETCH_SQL}, {PROBE_SQL}
SELECT u.site, count(*) AS probed, count(h.url) AS hits,
       CASE WHEN count(*) > 0 THEN count(h.url) * 100.0 / count(*) ELSE 0.0 END AS hit_rate
FROM urls u LEFT JOIN hits h ON h.site = u.site AND h.url = u.url GROUP BY u.site""")
def probe_hit_rate(spark, sf):
    urls, fetches = _probe_inputs(spark, sf)
    return FU.probe_hit_rate(urls, FU.probe_resolve(urls, fetches))


@query("remaining_urls", oracle=f"""
WITH {MD_FETCH_SQL}, {PROBE_SQL}
SELECT site, url FROM urls u
WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.site = u.site AND {D.normalize_url('h.url')} = {D.normalize_url('u.url')})""")
def remaining_urls(spark, sf):
    urls, fetches = _probe_inputs(spark, sf)
    return FU.remaining_urls(urls, FU.probe_resolve(urls, fetches)).select("site", "url")


def _repair_sql(title: str, content: str) -> str:
    lines = f"list_transform(regexp_split_to_array({content}, {D.q(D.LINE_END_RE)})[1:20], lambda l: {D.py_strip('l')})"
    cand = f"list_filter({lines}, lambda l: starts_with(l, '# ') OR starts_with(l, 'title: '))[1]"
    fixed = (f"(CASE WHEN starts_with({cand}, '# ') THEN {D.py_strip(f'substr({cand}, 3)')} "
             f"ELSE trim(trim({D.py_strip(f'substr({cand}, 8)')}, '\"'), '''') END)")
    needs = f"({title} IN ({', '.join(D.q(t) for t in D.PLACEHOLDER_TITLES)}) OR {title} IS NULL OR {title} = '')"
    return f"(CASE WHEN {needs} AND {cand} IS NOT NULL THEN {fixed} ELSE {title} END)"


@query("sitemap_urls", headline=True, oracle=f"SELECT DISTINCT {D.site_of('url')} AS site, url FROM pages")
def sitemap_urls(spark, sf):
    """Page URLs reachable from each site's sitemap index (index loop with a
    seen set; the index lists itself)."""
    fetches = FE.fetch_table(spark, sf, ("sitemap",))
    start = SM.scan_sitemaps(fetches).select("site", "url")
    return SM.resolve_sitemap_index(fetches, start)


@query("parse_sitemap", oracle=f"""
WITH s AS (SELECT {D.site_of('url')} AS site, min({D.site_root('url')}) AS root, count(*) AS n FROM pages GROUP BY 1)
SELECT {D.site_of('url')} AS site, 'url' AS kind, url AS loc FROM pages
UNION ALL
SELECT site, 'sitemap', root || '/sitemap-' || CAST(k AS VARCHAR) || '.xml'
FROM (SELECT site, root, unnest(range(0, CAST(greatest(1, ceil(n / {FE.URLS_PER_SITEMAP})) AS BIGINT))) AS k FROM s)
UNION ALL
SELECT site, 'sitemap', root || '/sitemap.xml' FROM s""")
def parse_sitemap(spark, sf):
    fetches = FE.fetch_table(spark, sf, ("sitemap",))
    return SM.parse_sitemap(fetches.select("site", "url", "body")).select("site", "kind", "loc")


@query("entry_pages", oracle=f"WITH {ENTRY_SQL} SELECT site, page_id, url, base_url FROM entry")
def entry_pages(spark, sf):
    return FU.entry_pages(read_table(spark, sf, "pages", "page_id", "url"))


_HEUR_SQL = f"""
{ENTRY_SQL}, {_ANCHORS},
edges AS (
  SELECT DISTINCT r.page_id, {D.clean_link_url('r.abs_url')} AS to_url FROM resolved r
  WHERE {D.url_netloc('r.abs_url')} = {D.url_netloc('r.url')} AND NOT ({_BLOCK.replace('abs_url', 'r.abs_url')})
), heur AS (
  SELECT DISTINCT e.site, x.to_url AS url, {D.title_from_url('x.to_url')} AS title,
         {D.depth_from_path('x.to_url')} AS depth
  FROM edges x JOIN entry e ON e.page_id = x.page_id
)"""


@query("url_nodes", oracle=f"WITH {_HEUR_SQL} SELECT site, url, title, depth FROM heur")
def url_nodes(spark, sf):
    """Link-scan nodes of each site's entry page: (site, url, title, depth)."""
    pages = _pages(spark, sf)
    entry = FU.entry_pages(pages.select("page_id", "url"))
    edges = L.link_edges(pages.join(entry.select("page_id"), "page_id", "left_semi"))
    nodes = FU.urls_to_nodes(edges.join(entry.select("site", "base_url"), "site")
                             .select("site", F.col("to_url").alias("url"), "base_url"))
    return nodes.select("site", "url", "title", "depth")


_SIDEBAR_SQL = f"""
{_NAV}, counted AS (
  SELECT page_id, count(*) AS n FROM nav_a GROUP BY page_id
), sb_entries AS (
  SELECT n.page_id, split_part(n.abs_url, '#', 1) AS url, n.i,
         {D.py_strip(decode("regexp_replace(a.t, '<[^>]*>', '', 'g')"))} AS title
  FROM nav_abs n JOIN nav_a a ON a.page_id = n.page_id AND a.i = n.i
  JOIN counted c ON c.page_id = n.page_id
  WHERE c.n > 3 AND n.href <> '' AND split_part(n.abs_url, '#', 1) <> ''
), sb_first AS (
  SELECT page_id, url, min(i) AS i FROM sb_entries GROUP BY page_id, url
), sidebar AS (
  SELECT e.site, f.url, s.title, 1 AS level,
         CAST(row_number() OVER (PARTITION BY f.page_id ORDER BY f.i) - 1 AS INTEGER) AS ord
  FROM sb_first f JOIN sb_entries s ON s.page_id = f.page_id AND s.i = f.i
  JOIN entry e ON e.page_id = f.page_id
)"""

_FUSED_SQL = f"""
{_HEUR_SQL}, {_SIDEBAR_SQL},
smap AS (
  SELECT DISTINCT p.site, p.url, e.base_url FROM (SELECT {D.site_of('url')} AS site, url FROM pages) p
  JOIN entry e ON e.site = p.site
), allsrc AS (
  SELECT site, url, coalesce(title, 'Untitled') AS title, level AS depth, ord, 'sidebar' AS source, 1 AS prio, -ord AS tie
  FROM sidebar
  UNION ALL
  SELECT site, url, {D.title_from_url('url')}, {D.estimate_depth('url', 'base_url')},
         {FU.SITEMAP_ORDER_BASE} + {D.estimate_depth('url', 'base_url')}, 'sitemap', 2, 0 FROM smap
  UNION ALL
  SELECT site, url, title, depth, {FU.HEURISTIC_ORDER_BASE} + depth, 'heuristic', 3, 0 FROM heur
), fused AS (
  SELECT site, url, title, depth, ord, source FROM allsrc
  QUALIFY row_number() OVER (PARTITION BY site, {D.canonical_url('url')} ORDER BY prio, tie, url) = 1
)"""


def _discovered(spark, sf):
    return discover(_pages(spark, sf), FE.fetch_table(spark, sf, ("sitemap",)))


@query("native_pages", oracle=f"""
WITH {_FUSED_SQL}, {MD_FETCH_SQL}, {PROBE_SQL}
SELECT h.site, h.url, {_repair_sql("coalesce(u.title, 'Untitled')", 'h.body')} AS title, md5(h.body) AS content_md5, 'native_probe' AS source
FROM hits h LEFT JOIN fused u ON u.site = h.site AND u.url = h.url""")
def native_pages(spark, sf):
    """Probe hits as page records, titled from the fused nodes; what they do
    not name is repaired from the content."""
    urls, fetches = _probe_inputs(spark, sf)
    p = FU.native_pages(FU.probe_resolve(urls, fetches), _discovered(spark, sf).fused.select("site", "url", "title"))
    return p.select("site", "url", "title", F.md5("content").alias("content_md5"), "source")


@query("fuse_sources", headline=True, oracle=f"WITH {_FUSED_SQL} SELECT site, url, title, depth, ord, source FROM fused")
def fuse_sources(spark, sf):
    """One hierarchy per site from sidebar, sitemap and link scan."""
    return _discovered(spark, sf).fused


@query("fused_order", oracle=f"""WITH {_FUSED_SQL}
SELECT site, url, source, row_number() OVER (PARTITION BY site ORDER BY ord, url) - 1 AS node_order FROM fused""")
def fused_order(spark, sf):
    """Fused nodes with their place in their site's reading order."""
    return FU.order_fused(_discovered(spark, sf).fused).select("site", "url", "source", "node_order")


@query("url_order", oracle=f"""
SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) - 1 AS node_order FROM (SELECT DISTINCT {D.site_of('url')} AS site, url FROM pages)""")
def url_order(spark, sf):
    """Every site's URLs with their place by name."""
    return FU.order_urls(_pages(spark, sf).select(U.site_of("url").alias("site"), "url"))


@query("discovery_counts", oracle=f"""
WITH {_FUSED_SQL},
c AS (
  SELECT site, count(*) FILTER (WHERE source = 'sidebar') AS sidebar, count(*) FILTER (WHERE source = 'sitemap') AS sitemap,
         count(*) FILTER (WHERE source = 'heuristic') AS heuristic
  FROM (SELECT site, 'sidebar' AS source FROM sidebar UNION ALL SELECT site, 'sitemap' FROM smap
        UNION ALL SELECT site, 'heuristic' FROM heur) GROUP BY site
)
SELECT c.site, c.sidebar, c.sitemap, c.heuristic, m.merged
FROM c JOIN (SELECT site, count(*) AS merged FROM fused GROUP BY site) m ON m.site = c.site""")
def discovery_counts(spark, sf):
    return _discovered(spark, sf).counts()


_HTML_TEXT = D.py_strip(decode("regexp_replace(regexp_extract(body, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g')"))
_H1 = D.py_strip(decode("regexp_extract(body, '<h1>(.*?)</h1>', 1)"))


def _body_title(body: str) -> str:
    md = f"regexp_extract({body}, '(?m)^#[ \\t\\n\\r\\f\\v]+(.*)', 1)"
    return (f"(CASE WHEN {body} IS NULL OR {body} = '' THEN 'Untitled Page' "
            f"WHEN regexp_matches({body}, '(?m)^#[ \\t\\n\\r\\f\\v]+') THEN {D.py_strip(md)} "
            f"WHEN length({_H1.replace('body', body)}) BETWEEN 1 AND 199 THEN {D.strip_title_suffix(_H1.replace('body', body))} END)")


_BODY_CTES = f"""
{MD_FETCH_SQL},
urls AS (SELECT DISTINCT {D.site_of('url')} AS site, url FROM pages),
md AS (
  SELECT u.site, u.url, f.url AS page_url, min(f.body) AS body FROM urls u
  JOIN md_fetch f ON f.site = u.site AND f.url = {D.md_url('u.url')} GROUP BY ALL
), html AS (
  SELECT u.site, u.url, min(p.html) AS body FROM urls u JOIN pages p ON p.url = u.url
  WHERE NOT EXISTS (SELECT 1 FROM md WHERE md.site = u.site AND md.url = u.url) GROUP BY ALL
), both_ AS (
  SELECT site, url, page_url, body AS content, 'sitemap-md' AS source, body AS tsrc FROM md
  UNION ALL
  SELECT site, url, url, {_HTML_TEXT}, 'sitemap-html', body FROM html WHERE {_HTML_TEXT} <> ''
)"""


@query("body_fallback", oracle=f"""
WITH {_BODY_CTES}
SELECT site, page_url AS url,
  coalesce(nullif({_body_title('tsrc')}, ''), {D.title_from_url('url', keep_underscore=True)}) AS title,
  md5(content) AS content_md5, source
FROM both_""")
def body_fallback(spark, sf):
    """Sitemap strategy pages: native ``.md`` when served, else the HTML text."""
    pages = read_table(spark, sf, "pages", "url")
    fetches = FE.fetch_table(spark, sf, ("html", "md"))
    urls = pages.select(U.site_of("url").alias("site"), "url").distinct()
    out = FU.body_fallback(urls, fetches)
    return out.select("site", "url", "title", F.md5("content").alias("content_md5"), "source")


# Repositories of which a check-out exists (a parameter of the queries).
CHECKED_OUT = ["https://github.com/org0/repo.git", "https://github.com/org1/repo.git"]

_REPO_SQL = f"""
repo_pages AS (SELECT page_id, url, {RICH_HTML} AS html FROM pages),
repo_links AS (
  SELECT page_id, url, {decode('h')} AS href, i FROM (
    SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h,
           generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) AS i FROM repo_pages)
), repos AS (
  SELECT {D.site_of('url')} AS site, split_part(href, '/blob/', 1) || '.git' AS repo_url FROM repo_links
  WHERE strpos(href, 'github.com') > 0 AND strpos(href, '/blob/') > 0
  QUALIFY row_number() OVER (PARTITION BY {D.site_of('url')} ORDER BY page_id, i) = 1
)"""


# Every eleventh file is no UTF-8, alike for both engines.
_BROKEN = "page_id % 11 = 3"


def _checkout(spark, sf) -> str:
    """A packed check-out with one Markdown file per page, written from ``pages``."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/checkout-{uuid.uuid4().hex}"
    body = F.concat(FE.markdown_body(F.col("html")), F.lit("\n")).cast("binary")
    content = F.when(F.expr(_BROKEN), F.concat(body, F.unhex(F.lit("FFFE")))).otherwise(body)
    path = F.concat(F.lit("docs/page-"), F.col("page_id"), F.lit(".md"))
    MF.pack_checkout(read_table(spark, sf, "pages", "page_id", "html").select(path.alias("path"), content.alias("content")), root)
    return root


def _page_of_path():
    return F.regexp_extract("path", r"page-([0-9]+)[.]md$", 1).cast("long").alias("page_id")


@query("markdown_corpus", oracle=f"""
WITH b AS (SELECT page_id, {_MD_BODY} || chr(10) AS body FROM pages)
SELECT page_id, CASE WHEN NOT ({_BROKEN}) THEN {D.py_strip("substr(split_part(body, chr(10), 1), 3)")} END AS title,
       CASE WHEN NOT ({_BROKEN}) THEN md5(body) END AS content_md5, 'github' AS source, CASE WHEN {_BROKEN} THEN 'not UTF-8' END AS error FROM b""")
def markdown_corpus(spark, sf):
    """Page records of a repository check-out: one per file, titled by its first
    heading; files that are no text are reported."""
    found = MF.scan_packed_checkout(spark, _checkout(spark, sf), "docs")
    return found.select(_page_of_path(), "title", F.md5("content").alias("content_md5"), "source", "error")


@query("strategy_fallback", oracle=f"""
WITH {_BODY_CTES}, {_REPO_SQL},
md_pages AS ({_md_oracle()}),
gh AS (SELECT {D.site_of('url')} AS site, count(*) AS n FROM pages
       WHERE NOT ({_BROKEN}) AND {D.site_of('url')} IN (SELECT site FROM repos WHERE repo_url IN ({', '.join(D.q(r) for r in CHECKED_OUT)})) GROUP BY 1),
sm AS (SELECT site, count(*) AS n FROM both_ GROUP BY site),
sc AS (SELECT {D.site_of('p.url')} AS site, count(*) AS n FROM md_pages m JOIN pages p ON p.page_id = m.page_id
       WHERE m.content <> '' AND (length({D.py_strip('m.content')}) > 50 OR coalesce(m.title, '') <> '') GROUP BY 1),
every AS (SELECT site, 1 AS rank, 'github' AS strategy, n FROM gh UNION ALL SELECT site, 2, 'sitemap', n FROM sm
          UNION ALL SELECT site, 3, 'scraping', n FROM sc)
SELECT site, strategy, n AS n_pages FROM every QUALIFY row_number() OVER (PARTITION BY site ORDER BY rank) = 1""")
def strategy_fallback(spark, sf):
    """Pages of the first strategy (github, sitemap, scraping) that yields any
    page, per site; counted per (site, strategy). A site's check-out is used
    if the repository that its pages link to is among those checked out."""
    pages = read_table(spark, sf, "pages", "page_id", "url", "html")
    fetches = FE.fetch_table(spark, sf, ("html", "md"))
    sites = pages.select("page_id", U.site_of("url").alias("site"), "url")
    urls = sites.select("site", "url").distinct()
    with_repo = L.detect_repo(rich_pages(pages)).where(F.col("repo_url").isin(*CHECKED_OUT)).select("site")
    files = MF.scan_packed_checkout(spark, _checkout(spark, sf)).where("error IS NULL").select(_page_of_path())
    github = (files.join(sites, "page_id").join(with_repo, "site", "left_semi")
              .select("site", "url", F.lit("github").alias("strategy")))
    sitemap = FU.body_fallback(urls, fetches).select("site", "url", F.lit("sitemap").alias("strategy"))
    scraping = (X.markdown_pages(pages).join(pages.select("page_id", "url"), "page_id")
                .where(P.min_content(F.col("content"), F.col("h1_title")))
                .select(U.site_of("url").alias("site"), "url", F.lit("scraping").alias("strategy")))
    kept = FU.strategy_fallback(github.unionByName(sitemap).unionByName(scraping))
    return kept.groupBy("site", "strategy").agg(F.count("*").alias("n_pages"))
