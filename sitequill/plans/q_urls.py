"""URL projection, filter and dedup queries over ``pages.url``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import urls as U
from ..sources.tables import read_table
from . import duck as D
from .registry import query

SECTION = "en"
EXCLUDE = ".html, /de/ ,, utm_source"


def _pages(spark, sf):
    return read_table(spark, sf, "pages", "page_id", "url")


@query("url_keys", oracle=f"""
SELECT page_id, url,
  {D.site_of('url')} AS site,
  {D.url_scheme('url')} AS scheme,
  {D.url_netloc('url')} AS netloc,
  {D.url_path('url')} AS path,
  {D.url_query('url')} AS query,
  {D.url_fragment('url')} AS fragment,
  {D.canonical_url('url')} AS canonical,
  {D.normalize_url('url')} AS normalized,
  {D.lookup_key('url')} AS lookup,
  {D.clean_link_url('url')} AS clean_link,
  {D.tree_key('url')} AS tree,
  {D.md_url('url')} AS md
FROM pages""")
def url_keys(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select(
        "page_id", "url",
        U.site_of(u).alias("site"),
        U.url_scheme(u).alias("scheme"),
        U.url_netloc(u).alias("netloc"),
        U.url_path(u).alias("path"),
        U.url_query(u).alias("query"),
        U.url_fragment(u).alias("fragment"),
        U.canonical_url(u).alias("canonical"),
        U.normalize_url(u).alias("normalized"),
        U.lookup_key(u).alias("lookup"),
        U.clean_link_url(u).alias("clean_link"),
        U.tree_key(u).alias("tree"),
        U.md_url(u).alias("md"),
    )


@query("url_titles", oracle=f"""
SELECT page_id,
  {D.title_from_url('url')} AS title,
  {D.title_from_url('url', keep_underscore=True)} AS title_keep_underscore,
  {D.py_title(D.url_path('url'))} AS path_title,
  {D.title_from_stem(D.url_path('url'))} AS stem_title,
  {D.depth_from_path('url')} AS depth,
  {D.estimate_depth('url', D.site_root('url'))} AS est_depth,
  {D.estimate_depth('url', D.site_root('url') + " || '/en'")} AS est_depth_en,
  {D.asset_filename('url')} AS file_name,
  {D.url_extension('url')} AS ext
FROM pages""")
def url_titles(spark, sf):
    u = F.col("url")
    root = U.site_root(u)
    return _pages(spark, sf).select(
        "page_id",
        U.title_from_url(u).alias("title"),
        U.title_from_url(u, keep_underscore=True).alias("title_keep_underscore"),
        U.py_title(U.url_path(u)).alias("path_title"),
        U.title_from_stem(U.url_path(u)).alias("stem_title"),
        U.depth_from_path(u).alias("depth"),
        U.estimate_depth(u, root).alias("est_depth"),
        U.estimate_depth(u, F.concat(root, F.lit("/en"))).alias("est_depth_en"),
        U.asset_filename(u).alias("file_name"),
        U.url_extension(u).alias("ext"),
    )


@query("url_dedup", headline=True, oracle=f"""
WITH k AS (
  SELECT {D.site_of('url')} AS site, {D.canonical_url('url')} AS ckey, page_id FROM pages
), firsts AS (
  SELECT site, ckey, min(page_id) AS page_id FROM k GROUP BY site, ckey
)
SELECT f.site, count(*) AS n_canonical, any_value(n.n_pages) AS n_pages, CAST(sum(f.page_id) AS BIGINT) AS sum_first_page_id
FROM firsts f JOIN (SELECT site, count(*) AS n_pages FROM k GROUP BY site) n ON f.site = n.site
GROUP BY f.site""")
def url_dedup(spark, sf):
    """First page per canonical URL, counted per host.

    Both steps are hash aggregates with a map-side partial, so a hot host or a
    hot canonical URL is combined before the shuffle.
    """
    k = _pages(spark, sf).select(U.site_of("url").alias("site"), U.canonical_url("url").alias("ckey"), "page_id")
    firsts = k.groupBy("site", "ckey").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))
    return firsts.groupBy("site").agg(
        F.count("*").alias("n_canonical"),
        F.sum("copies").alias("n_pages"),
        F.sum("page_id").alias("sum_first_page_id"),
    )


_EXCL = " AND ".join(f"strpos(lower(url), {D.q(t)}) = 0" for t in P.exclude_terms(EXCLUDE))
_SKIP = D.q(D.SKIP_RE)
_BLOCK = " OR ".join(f"strpos(lower({D.url_path('url')}), {D.q(t)}) > 0" for t in D.BLOCKED)


# The URL that links to a page, by the length of the page's own.
_LINKED = "CASE WHEN length(url) % 3 = 0 THEN replace(url, '://', '://www.') ELSE url END"


@query("url_filter", oracle=f"""
SELECT page_id,
  (strpos(lower(url), {D.q(SECTION)}) > 0 AND {_EXCL}) AS keep_section,
  strpos(url, {D.q(SECTION)}) > 0 AS keep_exact,
  (url IS NOT NULL AND url <> '' AND NOT starts_with(url, '#')
     AND {D.url_netloc('url')} = {D.url_netloc('entry')}
     AND NOT regexp_matches(lower(url), {_SKIP})) AS valid_page,
  ({_BLOCK}) AS blocked,
  regexp_matches(lower({D.url_path('url')}), {D.q(D.ASSET_RE)}) AS is_asset
FROM (SELECT *, {_LINKED} AS entry FROM pages)""")
def url_filter(spark, sf):
    """Filters of every URL; the host it must have is that of the URL it is
    taken to be linked from: its own site, or for some pages ``www.`` of it."""
    u = F.col("url")
    return _pages(spark, sf).withColumn("entry", F.expr(_LINKED)).select(
        "page_id",
        P.include_exclude(u, SECTION, EXCLUDE).alias("keep_section"),
        P.include_exclude(u, SECTION, None, case_sensitive=True).alias("keep_exact"),
        P.valid_page_url(u, U.url_netloc("entry")).alias("valid_page"),
        P.link_blocked(u).alias("blocked"),
        P.asset_extension(u).alias("is_asset"),
    )


@query("probe_candidates", oracle=f"""
SELECT page_id, 1 AS cand_rank, {D.lookup_key('url')} || '.md' AS cand_url FROM pages
UNION ALL
SELECT page_id, 2 AS cand_rank, {D.lookup_key('url')} || '/README.md' AS cand_url FROM pages
WHERE NOT ends_with({D.lookup_key('url')}, '.md')""")
def probe_candidates(spark, sf):
    return _pages(spark, sf).select("page_id", F.inline(U.md_candidates("url")))
