"""Queries over captured HTML: link graph, navigation, titles, text, Markdown,
sidebar hierarchy and structure probes.

The DuckDB oracles read the same ``pages`` table with regular expressions that
fit its markup (``<nav>``/``<article>``/``<h1>``, entity-encoded text).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as TX
from ..functions import urls as U
from ..operators import extract as X
from ..operators import links as L
from ..functions.elements import elements_function
from ..sources.rich_pages import ARTICLE_HTML, SIDEBAR_HTML, rich_oracle, rich_pages, sidebar_pages
from ..sources.tables import read_table
from . import duck as D
from .registry import query


def _pages(spark, sf):
    return read_table(spark, sf, "pages", "page_id", "url", "html")


def decode(x: str) -> str:
    """HTML entities present in the test pages, decoded once (``&amp;`` last)."""
    for ent, ch in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"),
                    ("&middot;", "·"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"replace({x}, {D.q(ent)}, {D.q(ch)})"
    return x


def resolve_sql(base: str, href: str) -> str:
    return (f"(CASE WHEN starts_with({href}, '//') THEN {D.url_scheme(base)} || ':' || {href} "
            f"WHEN starts_with({href}, '/') THEN {D.site_root(base)} || {href} "
            f"WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} END)")


_ANCHORS = f"""
anchors AS (
  SELECT page_id, url, {decode('h')} AS href
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
), resolved AS (
  SELECT page_id, url, {resolve_sql('url', 'href')} AS abs_url FROM anchors
)"""

_BLOCK = " OR ".join(f"strpos(lower({D.url_path('abs_url')}), {D.q(t)}) > 0" for t in D.BLOCKED)


@query("link_edges", headline=True, oracle=f"""
WITH {_ANCHORS}
SELECT DISTINCT page_id, {D.site_of('url')} AS site, {D.clean_link_url('abs_url')} AS to_url
FROM resolved
WHERE {D.url_netloc('abs_url')} = {D.url_netloc('url')} AND NOT ({_BLOCK})""")
def link_edges(spark, sf):
    return L.link_edges(_pages(spark, sf))


_NAV = f"""
navs AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages
), nav_a AS (
  SELECT page_id, url, unnest(regexp_extract_all(nav, '<a href="([^"]*)">(.*?)</a>', 1)) AS h,
         unnest(regexp_extract_all(nav, '<a href="([^"]*)">(.*?)</a>', 2)) AS t,
         generate_subscripts(regexp_extract_all(nav, '<a href="([^"]*)">(.*?)</a>', 1), 1) AS i
  FROM navs
), nav_r AS (
  SELECT page_id, url, i, {decode('h')} AS href,
         {D.py_strip(decode("regexp_replace(t, '<[^>]*>', '', 'g')"))} AS text
  FROM nav_a
), nav_abs AS (
  SELECT page_id, url, i, href, text, {resolve_sql('url', 'href')} AS abs_url FROM nav_r
)"""


@query("nav_links", oracle=f"""
WITH {_NAV}, valid AS (
  SELECT * FROM nav_abs
  WHERE href <> '' AND text <> '' AND abs_url IS NOT NULL AND abs_url <> '' AND NOT starts_with(abs_url, '#')
    AND {D.url_netloc('abs_url')} = {D.url_netloc('url')}
    AND NOT regexp_matches(lower(abs_url), {D.q(D.SKIP_RE)})
), firsts AS (
  SELECT page_id, abs_url, min(i) AS i FROM valid GROUP BY page_id, abs_url
), ordered AS (
  SELECT f.page_id, CAST(row_number() OVER (PARTITION BY f.page_id ORDER BY f.i) - 1 AS INTEGER) AS pos,
         f.abs_url AS url, left(v.text, 100) AS title
  FROM firsts f JOIN valid v ON v.page_id = f.page_id AND v.i = f.i
)
SELECT page_id, pos, url, title FROM ordered
UNION ALL
SELECT page_id, 0 AS pos, url, 'Main Page' AS title FROM pages
WHERE page_id NOT IN (SELECT page_id FROM ordered)""")
def nav_links(spark, sf):
    return L.nav_links(_pages(spark, sf))


_H1 = decode("regexp_extract(html, '<h1>(.*?)</h1>', 1)")
_TT = decode("regexp_extract(html, '<title>(.*?)</title>', 1)")


def _cut_suffix(x: str) -> str:
    return D.strip_title_suffix(D.py_strip(x))


@query("page_titles", oracle=f"""
WITH t AS (
  SELECT page_id, url, html, {D.py_strip(_H1)} AS h1, {D.py_strip(_TT)} AS tt FROM pages
)
SELECT page_id,
  CASE WHEN html IS NULL OR html = '' THEN 'Untitled Page'
       WHEN regexp_matches(html, '(?m)^#[ \\t\\n\\r\\f\\v]+') THEN {D.py_strip("regexp_extract(html, '(?m)^#[ \\t\\n\\r\\f\\v]+(.*)', 1)")}
       WHEN length(h1) BETWEEN 1 AND 199 THEN {_cut_suffix('h1')}
       WHEN length(tt) BETWEEN 1 AND 199 THEN {_cut_suffix('tt')}
       ELSE {D.title_from_url('url', keep_underscore=True)} END AS title
FROM t""")
def page_titles(spark, sf):
    """Title of a captured page: Markdown ``# `` line, else ranked HTML
    selectors (suffix cut), else derived from the URL."""
    # The Markdown and blank checks run in Catalyst and ride through the HTML pass.
    pages = _pages(spark, sf).select(
        "page_id", "url", "html",
        (F.coalesce(F.length("html"), F.lit(0)) == 0).alias("blank"),
        F.col("html").rlike(r"(?md)^#\s+").alias("md_hit"),
        TX.py_strip(F.regexp_extract("html", r"(?md)^#\s+(.*)", 1)).alias("md_title"),
        U.title_from_url("url", keep_underscore=True).alias("url_title"))
    t = X.map_pages(pages, X.title_rows, "html_title string", carry=["blank", "md_hit", "md_title", "url_title"])
    return t.select(
        "page_id",
        F.when(F.col("blank"), F.lit("Untitled Page"))
        .when(F.col("md_hit"), F.col("md_title"))
        .when(F.col("html_title").isNotNull(), F.col("html_title"))
        .otherwise(F.col("url_title")).alias("title"),
    )


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


@query("page_text", oracle=f"""
SELECT page_id, {D.py_strip(decode(f"regexp_replace({_ARTICLE}, '<[^>]*>', '', 'g')"))} AS content
FROM pages""")
def page_text(spark, sf):
    return X.text_pages(_pages(spark, sf)).select("page_id", "content")


def _md_oracle(src: str = "pages", keep: str = "page_id") -> str:
    """Markdown and h1 title of ``src.html`` (the test pages' markup), keeping ``keep`` columns."""
    rest = f"regexp_extract({_ARTICLE}, '(?s)</h1>(.*)$', 1)"
    head = f"(CASE WHEN strpos({rest}, '<p><b>') > 0 THEN split_part({rest}, '<p><b>', 1) ELSE {rest} END)"
    tail = f"(CASE WHEN strpos({rest}, '<p><b>') > 0 THEN substr({rest}, strpos({rest}, '<p><b>')) ELSE '' END)"
    clean = lambda x: D.py_strip(decode(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))
    paras = f"list_transform(regexp_extract_all({head}, '(?s)<p>(.*?)</p>', 1), lambda p: {clean('p')})"
    blocks = f"list_filter(list_append({paras}, {clean(tail)}), lambda b: b <> '')"
    h1 = D.py_strip(_H1)
    return f"""
SELECT {keep}, {h1} AS title,
  {D.py_strip(f"'# ' || {h1} || chr(10) || chr(10) || array_to_string({blocks}, chr(10) || chr(10))")} AS content
FROM {src}"""


@query("page_markdown", oracle=_md_oracle())
def page_markdown(spark, sf):
    """Main content as Markdown with the content's first ``h1`` as title."""
    md = X.markdown_pages(_pages(spark, sf))
    return md.select("page_id", F.coalesce("h1_title", F.lit("Untitled Page")).alias("title"), "content")


@query("sidebar_hierarchy", oracle=f"""
WITH {_NAV}, counted AS (
  SELECT page_id, count(*) AS n FROM nav_a GROUP BY page_id
), entries AS (
  SELECT n.page_id, split_part(n.abs_url, '#', 1) AS url, n.i,
         {D.py_strip(decode("regexp_replace(a.t, '<[^>]*>', '', 'g')"))} AS title
  FROM nav_abs n JOIN nav_a a ON a.page_id = n.page_id AND a.i = n.i
  JOIN counted c ON c.page_id = n.page_id
  WHERE c.n > 3 AND n.href <> '' AND split_part(n.abs_url, '#', 1) <> ''
), firsts AS (
  SELECT page_id, url, min(i) AS i FROM entries GROUP BY page_id, url
)
SELECT f.page_id, CAST(row_number() OVER (PARTITION BY f.page_id ORDER BY f.i) - 1 AS INTEGER) AS ord,
       1 AS level, CAST(NULL AS VARCHAR) AS section, f.url, e.title
FROM firsts f JOIN entries e ON e.page_id = f.page_id AND e.i = f.i""")
def sidebar_hierarchy(spark, sf):
    """Hierarchy read from each page's best sidebar (see ``extract.sidebar_entries``)."""
    return X.sidebar_hierarchy_rows(_pages(spark, sf)).select("page_id", "ord", "level", "section", "url", "title")


@query("selector_profile", oracle="""
WITH m AS (
  SELECT 'nav' AS selector, len(regexp_extract_all(html, '<nav[ >]')) AS n FROM pages
  UNION ALL SELECT '[data-testid="sidebar"]', len(regexp_extract_all(html, '<[a-z0-9]+ [^>]*data-testid="sidebar"')) FROM pages
  UNION ALL SELECT '.sidebar', len(regexp_extract_all(html, '<[a-z0-9]+ [^>]*class="([^"]* )?sidebar( [^"]*)?"')) FROM pages
  UNION ALL SELECT 'aside', len(regexp_extract_all(html, '<aside[ >]')) FROM pages
)
SELECT selector, count(*) FILTER (WHERE n > 0) AS n_pages, CAST(sum(n) AS BIGINT) AS n_matches FROM m GROUP BY selector""")
def selector_profile(spark, sf):
    """How many pages carry each sidebar structure, and how many matches."""
    prof = X.selector_profile_rows(_pages(spark, sf))
    return prof.groupBy("selector").agg(
        F.count_if(F.col("n_matches") > 0).alias("n_pages"), F.sum("n_matches").cast("long").alias("n_matches")
    )


@query("link_count_per_container", oracle="""
SELECT page_id, 0 AS cand_pos, 'nav' AS cand_tag,
       CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a[ >]')) AS INTEGER) AS n_links
FROM pages WHERE strpos(html, '<nav>') > 0""")
def link_count_per_container(spark, sf):
    """Links per sidebar candidate (nav, aside, div.*sidebar*, [data-testid=sidebar])."""
    return X.sidebar_candidates(_pages(spark, sf))


_TBL = "regexp_extract_all(html, '(?s)<table[^>]*>(.*?)</table>', 1)"
_TR = "regexp_extract_all(tbl, '(?s)<tr[^>]*>(.*?)</tr>', 1)"


@query("html_tables", oracle=rich_oracle(f"""
WITH t AS (
  SELECT page_id, unnest({_TBL}) AS tbl, generate_subscripts({_TBL}, 1) - 1 AS table_no FROM pages
), r AS (
  SELECT page_id, table_no, unnest({_TR}) AS tr, generate_subscripts({_TR}, 1) - 1 AS row_no FROM t
), c AS (
  SELECT page_id, table_no, row_no,
    list_transform(regexp_extract_all(tr, '(?s)<t[dh][^>]*>(.*?)</t[dh]>', 1),
                   lambda x: {D.py_strip(decode("regexp_replace(x, '<[^>]*>', ' ', 'g')"))}) AS cells
  FROM r
)
SELECT page_id, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, cells FROM c
WHERE len(cells) > 0"""))
def html_tables(spark, sf):
    """Rows of every table (``table`` or role table/grid) as cell arrays."""
    return X.table_cells(rich_pages(_pages(spark, sf)))


@query("detect_repo", oracle=rich_oracle(f"""
WITH a AS (
  SELECT page_id, url, {decode('h')} AS href, i FROM (
    SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h,
           generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) AS i FROM pages)
)
SELECT {D.site_of('url')} AS site, split_part(href, '/blob/', 1) || '.git' AS repo_url FROM a
WHERE strpos(href, 'github.com') > 0 AND strpos(href, '/blob/') > 0
QUALIFY row_number() OVER (PARTITION BY {D.site_of('url')} ORDER BY page_id, i) = 1"""))
def detect_repo(spark, sf):
    return L.detect_repo(rich_pages(_pages(spark, sf)))


_NEXT = "regexp_extract(html, '(?s)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>', 1)"


@query("embedded_json", oracle=rich_oracle(f"""
WITH n AS (SELECT page_id, {_NEXT} AS j FROM pages)
SELECT page_id, 'top' AS kind, unnest(json_keys(j)) AS key FROM n WHERE j <> '' AND json_valid(j)
UNION ALL
SELECT page_id, 'pageProps', unnest(json_keys(j, '$.props.pageProps')) FROM n
WHERE j <> '' AND json_valid(j) AND json_type(j, '$.props.pageProps') = 'OBJECT'
UNION ALL
SELECT page_id, 'json_script_id',
       unnest(regexp_extract_all(html, '<script[^>]*type="application/json"[^>]*id="([^"]*)"', 1)) FROM pages
WHERE {_NEXT} = ''"""))
def embedded_json(spark, sf):
    """Keys of embedded Next.js data or ids of JSON scripts per page."""
    return X.embedded_json(rich_pages(_pages(spark, sf)))


@query("scan_diagnostics", oracle=f"""
WITH {_ANCHORS}, edges AS (
  SELECT DISTINCT page_id, {D.clean_link_url('abs_url')} AS to_url FROM resolved
  WHERE {D.url_netloc('abs_url')} = {D.url_netloc('url')} AND NOT ({_BLOCK})
)
SELECT p.page_id, (SELECT count(*) FROM anchors a WHERE a.page_id = p.page_id) AS total_anchors,
       (SELECT count(*) FROM edges e WHERE e.page_id = p.page_id) AS filtered_links, 'heuristic' AS method
FROM pages p""")
def scan_diagnostics(spark, sf):
    """Per page: anchors seen, distinct same-host links kept, scan method."""
    pages = _pages(spark, sf)
    a = X.anchors(pages, keep_url=True)
    keep = (U.url_netloc("abs_url") == U.url_netloc("url")) & ~P.link_blocked("abs_url")
    per_page = a.groupBy("page_id").agg(
        F.count("*").alias("total_anchors"),
        F.count_distinct(F.when(keep, U.clean_link_url("abs_url"))).alias("filtered_links"))
    return (pages.select("page_id").join(per_page, "page_id", "left")
            .na.fill(0, ["total_anchors", "filtered_links"])
            .select("page_id", "total_anchors", "filtered_links", F.lit("heuristic").alias("method")))


@query("element_rows", oracle=rich_oracle(f"""
WITH a AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1)) AS h,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2)) AS t FROM pages
), g AS (SELECT page_id, {decode('h')} AS href, {D.py_strip(decode("regexp_replace(t, '<[^>]*>', '', 'g')"))} AS text FROM a)
SELECT page_id, 'a' AS tag, text, href FROM g WHERE strpos(href, 'github.com') > 0 OR starts_with(href, 'mailto:')
UNION ALL
SELECT page_id, 'script' AS tag, '' AS text, NULL AS href FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<script id="__NEXT_DATA__" type="application/json">')) FROM pages)"""))
def element_rows(spark, sf):
    """Elements by CSS selector, through the SQL table function in a lateral join."""
    elements_function(spark)
    rich_pages(_pages(spark, sf)).createOrReplaceTempView("rich_captured_pages")
    return spark.sql("""
      SELECT p.page_id, e.tag, CASE WHEN e.tag = 'script' THEN '' ELSE e.text END AS text, e.href
      FROM rich_captured_pages p, LATERAL elements('a[href*="github.com"], a[href^="mailto:"], script#__NEXT_DATA__[type$=json]', p.html) e""")


SIDED_SQL = f"""
sited AS (SELECT DISTINCT {D.site_of('url')} AS site, url FROM pages),
firsts AS (
  SELECT site, max(url) FILTER (k = 1) AS u1, max(url) FILTER (k = 2) AS u2, max(url) FILTER (k = 3) AS u3
  FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY url) AS k FROM sited) GROUP BY site
), sided AS (
  SELECT p.page_id, p.url, {SIDEBAR_HTML} AS html, u1, u2, u3, page_id % 3 <> 0 AS with_reference,
         CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a[ >]')) AS INTEGER) AS n_nav
  FROM pages p JOIN firsts f ON f.site = {D.site_of('p.url')}
)"""

# Links of the nested sidebar in document order.
SIDE_LINKS_SQL = f"""
side_links AS (
  SELECT page_id, url AS page_url, 0 AS i, 1 AS level, NULL::VARCHAR AS section, u1 AS href, 'Start' AS title FROM sided
  UNION ALL SELECT page_id, url, 1, 2, 'Guide & more', coalesce(u2, {resolve_sql('url', "'/g2'")}), 'Twox' FROM sided
  UNION ALL SELECT page_id, url, 2, 3, 'Guide & more', coalesce(u3, {resolve_sql('url', "'/g3'")}), 'Three' FROM sided
  UNION ALL SELECT page_id, url, 3, 2, 'Guide & more', {resolve_sql('url', "'/four' || CAST(page_id AS VARCHAR)")}, 'Four' FROM sided
  UNION ALL SELECT page_id, url, 3 + k, 2, 'Reference', {resolve_sql('url', "'/r' || CAST(k AS VARCHAR)")}, 'R' || CAST(k AS VARCHAR)
    FROM (SELECT *, unnest(range(1, 7)) AS k FROM sided WHERE with_reference)
)"""

SIDE_ENTRIES_SQL = f"""
{SIDED_SQL}, {SIDE_LINKS_SQL}, {_NAV},
side_entries AS (
  SELECT page_id, i, level, section, split_part(href, '#', 1) AS url, title FROM side_links
  SEMI JOIN (SELECT page_id FROM sided WHERE n_nav <= CASE WHEN with_reference THEN 10 ELSE 4 END) a USING (page_id)
  UNION ALL
  SELECT n.page_id, CAST(n.i AS INTEGER), 1, NULL, split_part(n.abs_url, '#', 1), {D.py_strip(decode("regexp_replace(a.t, '<[^>]*>', '', 'g')"))}
  FROM nav_abs n JOIN nav_a a ON a.page_id = n.page_id AND a.i = n.i
  SEMI JOIN (SELECT page_id FROM sided WHERE n_nav > CASE WHEN with_reference THEN 10 ELSE 4 END) b ON b.page_id = n.page_id
  WHERE n.href <> '' AND split_part(n.abs_url, '#', 1) <> ''
), side_rows AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS ord, CAST(level AS INTEGER) AS level, section, url, title
  FROM (SELECT * FROM side_entries QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY i) = 1)
)"""


@query("sidebar_sections", oracle=f"WITH {SIDE_ENTRIES_SQL} SELECT * FROM side_rows")
def sidebar_sections(spark, sf):
    """Hierarchy of pages with a nested, sectioned sidebar beside a plain one:
    the larger is read, whichever that is."""
    return X.sidebar_hierarchy_rows(sidebar_pages(_pages(spark, sf))).select("page_id", "ord", "level", "section", "url", "title")


@query("sidebar_containers", oracle=f"""
WITH {SIDED_SQL}
SELECT page_id, 0 AS cand_pos, 'aside' AS cand_tag, CASE WHEN with_reference THEN 10 ELSE 4 END AS n_links FROM sided
UNION ALL SELECT page_id, 1, 'nav', n_nav FROM sided""")
def sidebar_containers(spark, sf):
    """Links per sidebar candidate of pages that have two."""
    return X.sidebar_candidates(sidebar_pages(_pages(spark, sf)))


@query("page_markdown_blocks", oracle="""
SELECT page_id, 'Page ' || page_id AS title, '# Page ' || page_id || '\n\n' || CASE page_id % 4
  WHEN 0 THEN '### Lists & more\n\n- one bold ' || page_id || '\n- two\n\n- first\n\n```\nx = ' || page_id || '\ny = 2\n```'
  WHEN 1 THEN 'Text with c, link and  em\n\n| Key | N |  |\n| --- | --- | --- |\n| page ' || page_id || ' |  |  |\n| a | b | c |'
  WHEN 2 THEN '$x^{' || page_id || '}$ done\n $$\nsum ' || page_id || '\n$$'
  ELSE 'quoted ' || page_id || '\n## Last' END AS content
FROM pages""")
def page_markdown_blocks(spark, sf):
    """Markdown of lists, code, tables of unequal rows, links, images, formulas
    in line and displayed, and quotes."""
    return X.markdown_pages(rich_pages(_pages(spark, sf), ARTICLE_HTML)).select("page_id", F.col("h1_title").alias("title"), "content")
