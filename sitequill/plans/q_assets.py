"""Asset queries over page text derived from ``pages``.

Each page gets a Markdown body with image and file references built from its
id and language (relative, root-relative and absolute forms, a shared file
name on two hosts, a bare ``href``, skipped ``#``/``data:`` references); the
page's captured HTML is scanned with it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import assets as A
from ..sources import fetches as FE
from ..sources.tables import read_table
from . import duck as D
from .registry import query

_PARTS = [
    "'![logo](/static/logo.png) '",
    "'![' || CAST(page_id AS STRING) || '](img/p' || CAST(page_id AS STRING) || '.jpg?v=2) '",
    "'[manual](https://cdn.example.com/files/' || lang || '.pdf) '",
    "'[home](/) '",
    "'<img alt=\"b\" src=\"/img/banner.svg\"> '",
    "'<img src=\"https://cdn.example.com/img/banner.svg\"> '",
    "'see [spec [v2]](docs/v2.ZIP#part) '",
    "'href=\"#top\" src=\"data:abc\" '",
    "'href=/dl/archive.tar.gz '",
]
CONTENT_SQL = " || ".join(_PARTS)


def asset_pages(spark, sf):
    pages = read_table(spark, sf, "pages", "page_id", "url", "html")
    lang = F.regexp_extract("html", FE.LANG_RE, 1)
    return pages.select(U.site_of("url").alias("site"), "page_id", "url", "html", lang.alias("lang")).select(
        "site", "page_id", "url", "html", F.expr(CONTENT_SQL).alias("content"))


# The reference patterns as the rules state them, written out for the oracle.
_PATTERNS = [
    (r"!\[([^\]]*)\]\(([^)]+)\)", 2), (r"<img[^>]*src=[\"']([^\"']+)[\"'][^>]*>", 1), (r"src\s*=\s*[\"']([^\"']+)[\"']", 1),
    (r"\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]\(([^)]+)\)", 2),
    (r"href\s*=\s*(?:[\"']([^\"']*)[\"']|([^\s>]+))", 1), (r"href\s*=\s*(?:[\"']([^\"']*)[\"']|([^\s>]+))", 2),
]


def _resolve_sql(base: str, ref: str) -> str:
    path = D.url_path(base)
    dirpart = f"(CASE WHEN {path} = '' THEN '/' ELSE regexp_extract({path}, '^(.*/)', 1) END)"
    return (f"(CASE WHEN regexp_matches({ref}, '^(?i)https?://') THEN {ref} "
            f"WHEN starts_with({ref}, '//') THEN {D.url_scheme(base)} || ':' || {ref} "
            f"WHEN starts_with({ref}, '/') THEN {D.site_root(base)} || {ref} "
            f"ELSE {D.site_root(base)} || {dirpart} || {ref} END)")


def _refs_sql() -> str:
    text = "(content || html)"
    arrays = ", ".join(f"regexp_extract_all({text}, {D.q('(?i)' + p)}, {g})" for p, g in _PATTERNS)
    return f"""
apages AS (
  SELECT {D.site_of('url')} AS site, page_id, url, html, {CONTENT_SQL} AS content
  FROM (SELECT page_id, url, html, regexp_extract(html, {D.q(FE.LANG_RE)}, 1) AS lang FROM pages)
), refs AS (
  SELECT DISTINCT site, url AS base, {D.py_strip('r')} AS ref
  FROM (SELECT site, url, unnest(flatten([{arrays}])) AS r FROM apages)
), kept AS (
  SELECT * FROM refs WHERE NOT (ref IS NULL OR ref = '' OR starts_with(ref, '#') OR starts_with(ref, 'data:')
                               OR starts_with(ref, 'javascript:'))
), assets AS (
  SELECT DISTINCT site, {_resolve_sql('base', 'ref')} AS asset_url FROM kept
)"""


_ASSET_WHERE = f"regexp_matches(lower({D.url_path('asset_url')}), {D.q(D.ASSET_RE)})"


@query("asset_refs", oracle=f"WITH {_refs_sql()} SELECT site, asset_url FROM assets WHERE {_ASSET_WHERE}")
def asset_refs(spark, sf):
    return A.asset_refs(asset_pages(spark, sf))


@query("asset_inventory", oracle=f"""
WITH {_refs_sql()}, a AS (SELECT * FROM assets WHERE {_ASSET_WHERE}),
inv AS (SELECT site, asset_url, {D.asset_filename('asset_url')} AS file_name, {D.url_extension('asset_url')} AS ext FROM a)
SELECT i.site, i.asset_url, i.file_name, i.ext, i.asset_url = w.winner AS name_winner
FROM inv i JOIN (SELECT site, file_name, min(asset_url) AS winner FROM inv GROUP BY ALL) w
  ON w.site = i.site AND w.file_name = i.file_name""")
def asset_inventory(spark, sf):
    return A.asset_inventory(A.asset_refs(asset_pages(spark, sf)))


@query("asset_count", oracle=f"""
WITH {_refs_sql()} SELECT site, count(*) AS n_assets FROM assets WHERE {_ASSET_WHERE} GROUP BY site""")
def asset_count(spark, sf):
    return A.asset_refs(asset_pages(spark, sf)).groupBy("site").agg(F.count("*").alias("n_assets"))


@query("rewrite_asset_links", oracle=f"""
SELECT page_id, regexp_replace({CONTENT_SQL}, {D.q(D.IMAGE_LINK_RE)}, '![\\1](assets/\\2)', 'g') AS content
FROM (SELECT page_id, regexp_extract(html, {D.q(FE.LANG_RE)}, 1) AS lang FROM pages)""")
def rewrite_asset_links(spark, sf):
    p = asset_pages(spark, sf)
    return p.select("page_id", A.rewrite_asset_links(F.col("content")).alias("content"))
