"""Consolidation queries over page records derived from ``documents``/``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import consolidate as C
from ..sources import corpus as CP
from . import duck as D
from .registry import query

DOWNLOADED = "2024-01-01 00:00:00 UTC"
NL = "chr(10)"
HEAD = D.q(D.HEADING_RE)


# -- SQL twins -------------------------------------------------------------------

def _title_sql(t: str) -> str:
    return f"(CASE WHEN strpos({t}, '|') > 0 THEN {D.clean_title(t)} ELSE {t} END)"


def _score_sql(title: str, url: str) -> str:
    t = f"lower({title})"
    intro = " OR ".join(f"strpos({t}, {D.q(w)}) > 0" for w in C.INTRO_WORDS)
    over = " OR ".join(f"strpos({t}, {D.q(w)}) > 0" for w in C.OVERVIEW_WORDS)
    digits = f"regexp_extract({t}, '([0-9]+)', 1)"
    num = f"(CASE WHEN {digits} <> '' THEN CAST(800 AS DECIMAL(38,0)) - TRY_CAST({digits} AS DECIMAL(38,0)) ELSE 0 END)"
    words = f"len(list_filter(regexp_split_to_array({t}, {D.q('[' + C.WS_CLASS + ']+')}), lambda x: x <> ''))"
    segs = f"len(string_split({url}, '/'))"
    return (f"CAST((CASE WHEN {intro} THEN 1000 ELSE 0 END) + (CASE WHEN {over} THEN 900 ELSE 0 END) "
            f"+ coalesce({num}, 0) + greatest(0, 100 - {words}) + greatest(0, 50 - {segs}) AS DECIMAL(38,0))")


def _mapped_sql(pages_sql: str | None = CP.PAGES_SQL, hier_sql: str | None = CP.HIERARCHY_SQL) -> str:
    """``cpages`` (and ``chier``) CTEs unless given as None (defined by the caller), then ``mapped``."""
    defs = "".join(f"{n} AS ({q}),\n" for n, q in (("cpages", pages_sql), ("chier", hier_sql)) if q is not None)
    return f"""
{defs}mapped AS (
  SELECT p.*,
    CASE WHEN h1.url IS NOT NULL THEN h1.level ELSE h2.level END AS h_level,
    CASE WHEN h1.url IS NOT NULL THEN h1.ord ELSE h2.ord END AS h_ord,
    CASE WHEN h1.url IS NOT NULL THEN h1.section ELSE h2.section END AS h_section
  FROM cpages p
  LEFT JOIN chier h1 ON h1.site = p.site AND h1.url = p.url
  LEFT JOIN chier h2 ON h2.site = p.site AND ends_with(p.url, '.md') AND h2.url = substr(p.url, 1, length(p.url) - 3)
)"""


def _ordered_sql(hierarchy: bool, pages_sql: str | None = CP.PAGES_SQL,
                 hier_sql: str | None = CP.HIERARCHY_SQL) -> str:
    if hierarchy:
        return f"""{_mapped_sql(pages_sql, hier_sql)},
ordered AS (
  SELECT *, CASE WHEN site IN (SELECT site FROM chier) THEN CAST(coalesce(h_ord, {C.UNMAPPED_ORDER}) AS DECIMAL(38,0))
                 ELSE -({_score_sql('title', 'url')}) END AS k1, url AS k2 FROM mapped
)"""
    defs = f"cpages AS ({pages_sql}),\n" if pages_sql is not None else ""
    return f"""
{defs}ordered AS (
  SELECT *, CAST(NULL AS INTEGER) AS h_level, CAST(NULL AS VARCHAR) AS h_section,
         -({_score_sql('title', 'url')}) AS k1, url AS k2 FROM cpages
)"""


_KEPT = f"""
kept AS (
  SELECT *, {D.content_md5('content')} AS md5 FROM ordered
  WHERE content IS NOT NULL AND {D.py_strip('content')} <> ''
  QUALIFY row_number() OVER (PARTITION BY site, {D.content_md5('content')} ORDER BY k1, k2) = 1
)"""

_BREAKS = """
sec AS (
  SELECT site, k1, k2, url, h_section,
         lag(h_section) OVER (PARTITION BY site ORDER BY k1, k2) AS prev
  FROM kept WHERE h_section IS NOT NULL
), breaks AS (
  SELECT site, k1, k2, url, h_section AS section FROM sec WHERE prev IS NULL OR prev <> h_section
)"""


def _relevel_ctes(src: str, tested: bool = False) -> str:
    """CTEs r1..r4 over ``src`` (columns content, tgt, ptitle) ending in ``body``."""
    fold_t = D.fold_for_match("first_h.txt")
    fold_p = D.fold_for_match("ptitle")
    similar = f"({fold_t} = {fold_p} OR strpos({fold_t}, {fold_p}) > 0 OR strpos({fold_p}, {fold_t}) > 0)"
    if tested:
        dupe = f"(first_h IS NOT NULL AND {similar})"
        base = "(CASE WHEN min_level = 1 AND dupe THEN tgt ELSE tgt + 1 END)"
    else:
        dupe = f"(first_h IS NOT NULL AND coalesce(ptitle, '') <> '' AND {similar})"
        base = "(tgt + 1)"
    rewrite = (f"list_transform(lines, lambda l, i: CASE WHEN heads[i].lvl > 0 THEN "
               f"CASE WHEN dupe AND i = first_idx THEN NULL ELSE "
               f"repeat('#', greatest(1, heads[i].lvl + ({base} - min_level))) || ' ' || heads[i].txt END ELSE l END)")
    joined = f"array_to_string(list_filter({rewrite}, lambda x: x IS NOT NULL), {NL})"
    processed = joined if tested else D.py_strip(D.squeeze_newlines(joined))
    return f"""
r1 AS (SELECT *, string_split(content, {NL}) AS lines FROM {src}),
r2 AS (SELECT *, list_transform(lines, lambda l: {{'lvl': length(regexp_extract(l, {HEAD}, 1)),
                                                  'txt': {D.py_strip(f"regexp_extract(l, {HEAD}, 2)")}}}) AS heads FROM r1),
r3 AS (SELECT *, list_min(list_filter(list_transform(heads, lambda h: h.lvl), lambda x: x > 0)) AS min_level,
              list_filter(heads, lambda h: h.lvl > 0)[1] AS first_h,
              list_position(list_transform(heads, lambda h: h.lvl > 0), true) AS first_idx FROM r2),
r4 AS (SELECT *, {dupe} AS dupe FROM r3),
r5 AS (SELECT *, CASE WHEN min_level IS NULL THEN content ELSE {processed} END AS body FROM r4)"""


def _header_sql(bases_sql: str = CP.BASE_URLS_SQL) -> str:
    host = D.url_netloc("b.base_url")
    for suffix in C.TITLE_HOST_SUFFIXES:
        host = f"replace({host}, {D.q(suffix)}, '')"
    title = D.py_title(host)
    return f"""
hdr AS (
  SELECT b.site, 0 AS part, CAST(NULL AS DECIMAL(38,0)) AS k1, CAST(NULL AS VARCHAR) AS k2,
    '# ' || {title} || {NL} || {NL} || {D.q(C.TOOL_LINE)} || {NL} || {NL} || '**Source:** ' || b.base_url
    || '  ' || {NL} || '**Pages:** ' || CAST(c.n AS VARCHAR) || '  ' || {NL} || '**Downloaded:** '
    || {D.q(DOWNLOADED)} || '  ' || {NL} || {NL} || '---' || {NL} AS block
  FROM ({bases_sql}) b JOIN (SELECT site, count(*) AS n FROM cpages GROUP BY site) c ON c.site = b.site
)"""


def _document_sql(hierarchy: bool, tested: bool = False, pages_sql: str | None = CP.PAGES_SQL,
                  hier_sql: str | None = CP.HIERARCHY_SQL, bases_sql: str = CP.BASE_URLS_SQL,
                  prefix: str = "") -> str:
    """Consolidated blocks; ``prefix`` holds CTEs the page/hierarchy/base SQL refer to."""
    return f"""
WITH {prefix}{_ordered_sql(hierarchy, pages_sql, hier_sql)}, {_KEPT}, {_BREAKS},
src AS (
  SELECT k.site, k.k1, k.k2, k.content, coalesce(k.h_level + 1, 2) AS tgt, {_title_sql('k.title')} AS ptitle,
         b.section
  FROM kept k LEFT JOIN breaks b ON b.site = k.site AND b.k1 = k.k1 AND b.k2 = k.k2
), {_relevel_ctes('src', tested)}, {_header_sql(bases_sql)}
SELECT site, part, k1, k2, block FROM hdr
UNION ALL
SELECT site, 1 AS part, k1, k2,
  {D.squeeze_newlines(f"(CASE WHEN section IS NOT NULL THEN {NL} || '## ' || section || {NL} || {NL} ELSE '' END) || repeat('#', greatest(tgt, 0)) || ' ' || ptitle || {NL} || {NL} || body || {NL} || {NL} || '---' || {NL}")} AS block
FROM r5"""


# -- queries ----------------------------------------------------------------------

def _inputs(spark, sf):
    return CP.corpus_pages(spark, sf), CP.corpus_hierarchy(spark, sf), CP.corpus_base_urls(spark, sf)


@query("hierarchy_join", oracle=f"WITH {_mapped_sql()} SELECT site, url, h_level, h_ord, h_section FROM mapped")
def hierarchy_join(spark, sf):
    pages, hier, _ = _inputs(spark, sf)
    return C.hierarchy_lookup(pages, hier).select("site", "url", "h_level", "h_ord", "h_section")


@query("order_by_heuristic", oracle=f"""
WITH pages AS ({CP.PAGES_SQL}) SELECT site, url, {_score_sql('title', 'url')} AS score FROM pages""")
def order_by_heuristic(spark, sf):
    pages = CP.corpus_pages(spark, sf)
    return pages.select("site", "url", C.heuristic_score(F.col("title"), F.col("url")).alias("score"))


@query("dedup_content", oracle=f"WITH {_ordered_sql(True)}, {_KEPT} SELECT site, url, md5 FROM kept")
def dedup_content(spark, sf):
    pages, hier, _ = _inputs(spark, sf)
    return C.kept_pages(pages, hier).select("site", "url", "md5")


@query("min_heading_level", oracle=f"""
WITH pages AS ({CP.PAGES_SQL}), src AS (SELECT site, url, content, 2 AS tgt, title AS ptitle FROM pages),
{_relevel_ctes('src')}
SELECT site, url, CAST(coalesce(min_level, 99) AS INTEGER) AS min_level, coalesce(first_h.txt, '') AS first_text FROM r3""")
def min_heading_level(spark, sf):
    pages = CP.corpus_pages(spark, sf)
    m = C.min_heading(F.col("content"))
    return pages.select("site", "url", m["min_level"].alias("min_level"), m["first_text"].alias("first_text"))


def _relevel_query(tested: bool):
    def run(spark, sf):
        pages, hier, _ = _inputs(spark, sf)
        p = C.hierarchy_lookup(pages, hier)
        t = F.when(F.col("title").contains("|"), TX.clean_title("title")).otherwise(F.col("title"))
        p = p.select("site", "url", "content", F.coalesce(F.col("h_level") + 1, F.lit(2)).alias("tgt"), t.alias("ptitle"))
        return C.relevel(p, "content", "tgt", "ptitle", "body", tested).select("site", "url", "body")
    return run


_RELEVEL_SRC = f"""src AS (SELECT site, url, content, coalesce(h_level + 1, 2) AS tgt, {_title_sql('title')} AS ptitle
                 FROM mapped)"""

query("releveled_pages", oracle=f"WITH {_mapped_sql()}, {_RELEVEL_SRC}, {_relevel_ctes('src')} SELECT site, url, body FROM r5")(
    _relevel_query(False))
query("releveled_tested_rule",
      oracle=f"WITH {_mapped_sql()}, {_RELEVEL_SRC}, {_relevel_ctes('src', True)} SELECT site, url, body FROM r5")(
    _relevel_query(True))


@query("section_breaks", oracle=f"WITH {_ordered_sql(True)}, {_KEPT}, {_BREAKS} SELECT site, k1, k2, url, section FROM breaks")
def section_breaks(spark, sf):
    pages, hier, _ = _inputs(spark, sf)
    return C.section_breaks(C.kept_pages(pages, hier))


@query("document_header", oracle=f"WITH cpages AS ({CP.PAGES_SQL}), {_header_sql()} SELECT site, block FROM hdr")
def document_header(spark, sf):
    pages, _, bases = _inputs(spark, sf)
    return C.document_header(pages, bases, DOWNLOADED).select("site", "block")


@query("consolidated_document", headline=True, oracle=_document_sql(True))
def consolidated_document(spark, sf):
    """Every site's document as ordered blocks, sidebar-hierarchy reading order."""
    pages, hier, bases = _inputs(spark, sf)
    return C.consolidate(pages, hier, bases, DOWNLOADED)


@query("consolidated_heuristic", oracle=_document_sql(False))
def consolidated_heuristic(spark, sf):
    """Every site's document as ordered blocks, heuristic (title score) order."""
    pages, _, bases = _inputs(spark, sf)
    return C.consolidate(pages, None, bases, DOWNLOADED)
