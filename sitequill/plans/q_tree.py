"""Document-tree queries: trees from captured sidebars, layout detection,
verification against sitemap URLs, breadcrumb healing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import fusion as FU
from ..operators import tree as TR
from ..session import cut_lineage
from ..sources.rich_pages import CRUMBED_HTML, FIRST_LINK, TOC_HTML, rich_oracle, rich_pages, sidebar_pages
from ..sources.tables import read_table
from . import duck as D
from .q_html import _NAV, SIDE_LINKS_SQL, SIDED_SQL, decode, resolve_sql
from .registry import query


def _pages(spark, sf):
    return read_table(spark, sf, "pages", "page_id", "url", "html")


_TREE_SQL = f"""
{_NAV}, ul_nav AS (
  SELECT n.page_id, n.i, n.abs_url, {D.py_strip(decode("regexp_replace(a.t, '<[^>]*>', '', 'g')"))} AS title,
         n.href
  FROM nav_abs n JOIN nav_a a ON a.page_id = n.page_id AND a.i = n.i
), tree AS (
  SELECT page_id, CAST(i AS INTEGER) AS node_id, 0 AS parent_id, title, 1 AS level,
         CASE WHEN href <> '' THEN split_part(abs_url, '#', 1) END AS url, CAST(i - 1 AS INTEGER) AS sib_ord
  FROM ul_nav
)"""


@query("sidebar_tree", oracle=f"WITH {_TREE_SQL} SELECT * FROM tree")
def sidebar_tree(spark, sf):
    """Adjacency tree of every page's first list (nested layout), or of its
    toclink anchors (flat layout)."""
    return TR.page_trees(_pages(spark, sf))


@query("layout_kind", oracle=rich_oracle("""
WITH q AS (SELECT 1 AS one)
SELECT page_id, CASE WHEN n > 3 THEN 'flat' ELSE 'nested' END AS layout, CAST(n AS INTEGER) AS n_toclinks
FROM (SELECT page_id, len(regexp_extract_all(html, '<a [^>]*class="[^"]*toclink[^"]*"')) AS n FROM pages)""", TOC_HTML))
def layout_kind(spark, sf):
    """Layout of every page's table of contents; every third page gets a flat one."""
    return TR.page_layouts(rich_pages(_pages(spark, sf), TOC_HTML))


_ENTRY_TREE_SQL = f"""
WITH {_TREE_SQL},
entry AS (
  SELECT site, page_id FROM (
    SELECT page_id, url, {D.site_of('url')} AS site, {D.canonical_url('url')} AS ckey FROM pages)
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY length(ckey), ckey, page_id) = 1
), etree AS (SELECT e.site, t.* FROM tree t JOIN entry e ON e.page_id = t.page_id),
keys AS (SELECT DISTINCT site, {D.tree_key('url')} AS k FROM etree WHERE url IS NOT NULL),
smap AS (SELECT DISTINCT {D.site_of('url')} AS site, url FROM pages)"""


def _entry_inputs(spark, sf):
    pages = _pages(spark, sf)
    entry = FU.entry_pages(pages.select("page_id", "url"))
    tree = TR.page_trees(pages.join(entry.select("page_id"), "page_id", "left_semi")).join(
        entry.select("page_id", "site"), "page_id").drop("page_id")
    smap = pages.select(U.site_of("url").alias("site"), "url").distinct()
    return pages, tree, smap


@query("tree_urls", oracle=f"{_ENTRY_TREE_SQL} SELECT site, k AS url FROM keys")
def tree_urls(spark, sf):
    _, tree, _ = _entry_inputs(spark, sf)
    return tree.where(F.col("url").isNotNull()).select("site", U.tree_key("url").alias("url")).distinct()


@query("missing_from_tree", oracle=f"""{_ENTRY_TREE_SQL}
SELECT s.site, s.url FROM smap s
WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.site = s.site AND k.k = {D.tree_key('s.url')})""")
def missing_from_tree(spark, sf):
    """Each site's page URLs that its entry page's tree does not reach."""
    _, tree, smap = _entry_inputs(spark, sf)
    return TR.missing_from_tree(tree, smap)


_CRUMB = D.py_strip(decode("x"))
_TITLE = ("trim(regexp_replace(" + decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
          + ", '[\t\n\f\r ]+', ' ', 'g'), chr(9) || chr(10) || chr(12) || chr(13) || ' ')")
HEAL_SQL = _ENTRY_TREE_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
miss AS (
  SELECT s.site, s.url FROM smap s
  WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.site = s.site AND k.k = {D.tree_key('s.url')})
), firsts AS (
  SELECT e.site, {FIRST_LINK} AS first FROM pages p JOIN entry e ON e.page_id = p.page_id
), crumbed AS (
  SELECT f.site, p.url, {_TITLE} AS page_title,
    list_filter(list_transform(regexp_extract_all(regexp_extract({CRUMBED_HTML}, '(?s)<nav aria-label="Breadcrumb">(.*?)</nav>', 1),
      '<li>(.*?)</li>', 1), lambda x: {_CRUMB}), lambda x: x <> '' AND x <> '/') AS raw
  FROM pages p JOIN firsts f ON f.site = {D.site_of('p.url')}
), cr AS (
  SELECT m.site, m.url, c.page_title, c.raw,
    CASE WHEN len(c.raw) > 0 AND lower(c.raw[1]) IN ('home', 'docs', 'documentation root') THEN c.raw[2:] ELSE c.raw END AS cut
  FROM miss m JOIN crumbed c ON c.site = m.site AND c.url = m.url
), w AS (
  SELECT site, url, CASE WHEN len(raw) = 0 THEN page_title ELSE coalesce(cut[-1], 'Untitled') END AS own_title,
         CASE WHEN len(raw) = 0 THEN [] ELSE cut[1 : greatest(len(cut) - 1, 0)] END AS dirs FROM cr
), kids AS (
  SELECT site, CAST(parent_id AS VARCHAR) AS p, lower(title) AS key, CAST(node_id AS VARCHAR) AS child, level FROM etree
  QUALIFY row_number() OVER (PARTITION BY site, parent_id, lower(title) ORDER BY sib_ord) = 1
), walk AS (
  -- One row a URL and depth: the node it stands on, and how that came to be.
  SELECT site, url, own_title, dirs, 0 AS d, '0' AS node, 0 AS lvl, NULL::VARCHAR AS above, NULL::VARCHAR AS made FROM w
  UNION ALL
  SELECT site, url, own_title, dirs, d + 1,
    coalesce(child, CASE WHEN f.goes_on THEN CASE WHEN starts_with(node, 'dir:') THEN '' ELSE 'dir:' END || node || '/' || key ELSE 'page:' || f.url END),
    coalesce(clvl, lvl + 1), node, CASE WHEN child IS NULL AND f.goes_on THEN f.title END
  FROM (
    SELECT x.*, k.child, k.level AS clvl,
      first_value(struct_pack(url := x.url, goes_on := x.goes_on, title := x.title)) OVER (PARTITION BY x.site, x.node, x.key ORDER BY x.url) AS f
    FROM (SELECT *, d < len(dirs) AS goes_on, CASE WHEN d < len(dirs) THEN dirs[d + 1] ELSE own_title END AS title,
                 lower(CASE WHEN d < len(dirs) THEN dirs[d + 1] ELSE own_title END) AS key FROM walk) x
    LEFT JOIN kids k ON k.site = x.site AND k.p = x.node AND k.key = x.key)
  WHERE goes_on
)
SELECT site, 'page:' || url AS node_id, node AS parent_id, own_title AS title, CAST(lvl + 1 AS INTEGER) AS level, url FROM walk WHERE d = len(dirs)
UNION ALL
SELECT DISTINCT site, node, above, made, CAST(lvl AS INTEGER), CAST(NULL AS VARCHAR) FROM walk WHERE made IS NOT NULL"""


@query("heal_tree", oracle=HEAL_SQL)
def heal_tree(spark, sf):
    """Nodes that attach every missing URL to its site's tree by breadcrumbs.
    The pages get breadcrumbs of all kinds first: none, into an existing
    directory, into new ones, into a new one below an existing one, below a
    page that another one's breadcrumbs name."""
    pages, tree, smap = _entry_inputs(spark, sf)
    # The tree is read by the verification and by every matching round: computed once.
    tree = cut_lineage(tree)
    missing = cut_lineage(TR.missing_from_tree(tree, smap))
    entry = FU.entry_pages(pages.select("page_id", "url"))
    first = pages.join(entry.select("page_id", "site"), "page_id").select("site", F.expr(FIRST_LINK).alias("first"))
    sited = pages.withColumn("site", U.site_of("url")).join(first, "site")
    crumbed = sited.select("page_id", "url", F.expr(CRUMBED_HTML).alias("html"))
    crumbs = TR.page_crumbs(crumbed.join(missing.select("url").distinct(), "url", "left_semi"), keep_url=True).select(
        U.site_of("url").alias("site"), "url", "crumbs", "page_title")
    return TR.heal_tree(tree, missing, cut_lineage(crumbs))


@query("sidebar_tree_sections", oracle=f"""
WITH {SIDED_SQL}, {SIDE_LINKS_SQL}, items AS (
  -- Node and parent numbers as the items stand: two headers hold links of their own.
  SELECT page_id, CASE WHEN i = 0 THEN 1 WHEN i <= 3 THEN i + 2 ELSE i + 3 END AS node_id,
         CASE WHEN i = 0 THEN 0 WHEN i = 2 THEN 3 WHEN i <= 3 THEN 2 ELSE 6 END AS parent_id, title, level, split_part(href, '#', 1) AS url,
         CASE WHEN i IN (0, 1, 2) THEN 0 WHEN i = 3 THEN 1 ELSE i - 4 END AS sib_ord FROM side_links
  UNION ALL SELECT page_id, 2, 0, 'Guide & more', 1, NULL, 1 FROM sided
  UNION ALL SELECT page_id, 6, 0, 'Reference', 1, NULL, 2 FROM sided WHERE with_reference
), flat AS (
  SELECT page_id, k AS node_id, 0 AS parent_id, substr('TUVW', k, 1) AS title, 1 AS level,
         {resolve_sql('url', "CASE k WHEN 1 THEN '/t' || CAST(page_id AS VARCHAR) WHEN 2 THEN '/u' WHEN 3 THEN '/v' ELSE '/w' END")} AS url, k - 1 AS sib_ord
  FROM (SELECT *, unnest(range(1, 5)) AS k FROM sided WHERE page_id % 3 = 0)
), every AS (SELECT * FROM items WHERE page_id % 3 <> 0 UNION ALL SELECT * FROM flat)
SELECT page_id, CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, title, CAST(level AS INTEGER) AS level, url,
       CAST(sib_ord AS INTEGER) AS sib_ord FROM every""")
def sidebar_tree_sections(spark, sf):
    """Trees of nested sidebars with labelled sections; every third page has a
    table of contents of marked links instead (flat layout)."""
    return TR.page_trees(rich_pages(sidebar_pages(_pages(spark, sf)), TOC_HTML))
