"""Pages with markup that the given table lacks, derived from it by SQL.

Each expression is plain SQL that Spark and DuckDB read alike; what it adds
depends on the page's id alone, so the derived table grows with ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

#: Tables, repository links and JSON scripts, put before the article's end.
RICH_HTML = """replace(html, '</article>', concat(CASE page_id % 4
  WHEN 0 THEN concat('<table><tr><th>Key</th><th>N</th></tr><tr><td>page <b>', page_id, '</b></td><td>', page_id % 7, '</td></tr></table>')
  WHEN 1 THEN concat('<a href="https://github.com/org', page_id % 5, '/repo/blob/main/docs/', page_id, '.md">Edit</a><a href="https://github.com/org/other">other</a>')
  WHEN 2 THEN concat('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"page": ', page_id, ', "nav": []}}, "buildId": "b', page_id % 3, '"}</script>')
  ELSE concat('<table><tr><td>only</td></tr><tr></tr></table><table><tr><td>second ', page_id, '</td></tr></table><script type="application/json" id="cfg', page_id % 3, '">{}</script>')
END, '</article>'))"""

#: A table of contents of marked links (flat layout) on every third page.
TOC_HTML = """CASE WHEN page_id % 3 = 0 THEN replace(html, '<nav>', concat(
  '<div><a class="x toclink" href="/t', page_id, '">T</a><a class="toclink" href="/u">U</a>',
  '<a class="toclink" href="/v">V</a><a class="toclink" href="/w">W</a></div><nav>')) ELSE html END"""

#: Breadcrumbs: none, under a link of the site's entry page (``first``), under
#: two new directories, under one new directory below that link (every seventh
#: page: below a page restored itself).
CRUMBED_HTML = """replace(html, '<article>', concat(CASE page_id % 4
  WHEN 0 THEN ''
  WHEN 1 THEN concat('<nav aria-label="Breadcrumb"><ol><li>Home</li><li>', first, '</li><li>Leaf ', page_id, '</li></ol></nav>')
  WHEN 2 THEN concat('<nav aria-label="Breadcrumb"><ol><li>Docs</li><li>Section X', page_id % 3, '</li><li>/</li><li>Deep</li><li>Leaf ', page_id, '</li></ol></nav>')
  ELSE concat('<nav aria-label="Breadcrumb"><ol><li>', first, '</li><li>', CASE WHEN page_id % 7 = 0 THEN concat('leaf ', page_id - 2) ELSE concat('New ', page_id % 5) END, '</li><li>Leaf ', page_id, '</li></ol></nav>')
END, '<article>'))"""

#: Text of the first navigation link, as it stands in the markup.
FIRST_LINK = """regexp_extract(html, '<li><a href="[^"]*">([^<]*)</a>', 1)"""


#: Articles of lists and code, of tables, links and images, of formulas, of
#: quotes and headings only, by the page's id. The parts around stay.
ARTICLE_HTML = """concat(split_part(html, '<article>', 1), '<article><h1>Page ', page_id, '</h1>', CASE page_id % 4
  WHEN 0 THEN concat('<h3>Lists &amp; more</h3><ul><li>one <b>bold</b> ', page_id, '</li><li>two</li></ul><ol><li>first</li></ol><pre><code class="language-python">x = ', page_id, '\ny = 2</code></pre>')
  WHEN 1 THEN concat('<p>Text with <code>c</code>, <a href="/l', page_id, '">link</a> and <img src="/i.png" alt="pic"> <em>em</em></p><table><tr><th>Key</th><th>N</th></tr><tr><td>page ', page_id, '</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>')
  WHEN 2 THEN concat('<p><span class="katex"><span class="katex-mathml"><math><semantics><annotation encoding="application/x-tex">x^{', page_id, '}</annotation></semantics></math></span><span class="katex-html">shown</span></span> done</p><div><span class="katex"><span class="katex-display"><annotation encoding="application/x-tex">sum ', page_id, '</annotation></span></span></div>')
  ELSE concat('<blockquote>quoted ', page_id, '</blockquote><hr><h2>Last</h2>')
END, '</article>', split_part(html, '</article>', 2))"""

_HREF = "replace(replace({}, '&', '&amp;'), '\"', '&quot;')"

#: A nested sidebar before the navigation, of the site's first URLs by name
#: (u1 to u3) and some of its own: three levels, two labelled sections (the
#: second on two pages of three), a link with inner markup, one with a fragment.
SIDEBAR_HTML = f"""replace(html, '<nav>', concat('<aside class="side"><ul><li><a href="', {_HREF.format('u1')},
  '">Start</a></li><li><div>Guide &amp; more</div><ul><li><a href="', coalesce({_HREF.format('u2')}, '/g2'), '">Two <b>x</b></a><ul><li><a href="',
  coalesce({_HREF.format('u3')}, '/g3'), '#part">Three</a></li></ul></li><li><a href="/four', page_id, '">Four</a></li></ul></li>',
  CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('<li><div>Reference</div><ul>',
    '<li><a href="/r1">R1</a></li><li><a href="/r2">R2</a></li><li><a href="/r3">R3</a></li>',
    '<li><a href="/r4">R4</a></li><li><a href="/r5">R5</a></li><li><a href="/r6">R6</a></li></ul></li>') END,
  '</ul></aside><nav>'))"""


def sidebar_pages(pages: DataFrame) -> DataFrame:
    """Pages with ``SIDEBAR_HTML``. A site's first URLs are ranked with a limit,
    so that a window holds no more than those."""
    sited = pages.select(U.site_of("url").alias("site"), "url").distinct()
    rank = F.row_number().over(Window.partitionBy("site").orderBy("url"))
    ranked = sited.withColumn("k", rank).where("k <= 3")
    firsts = ranked.groupBy("site").agg(*[F.max(F.when(F.col("k") == i, F.col("url"))).alias(f"u{i}") for i in (1, 2, 3)])
    return pages.withColumn("site", U.site_of("url")).join(firsts, "site").select("page_id", "url", F.expr(SIDEBAR_HTML).alias("html"))


def rich_pages(pages: DataFrame, html: str = RICH_HTML) -> DataFrame:
    return pages.select("page_id", "url", F.expr(html).alias("html"))


def rich_oracle(sql: str, html: str = RICH_HTML) -> str:
    """The same derivation ahead of an oracle ``WITH ...`` over ``pages``."""
    head, body = sql.strip().split(None, 1)
    if head.upper() != "WITH":
        raise ValueError("an oracle that begins WITH")
    return f"WITH rich AS (SELECT page_id, url, {html} AS html FROM pages), " + body.replace("FROM pages", "FROM rich")
