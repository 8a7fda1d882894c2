"""Library and heading-audit queries over the consolidated corpus documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import assets as A
from ..operators import consolidate as C
from ..operators import library as LB
from ..operators.document_table import DocumentTable
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import corpus as CP
from ..sources.tables import read_table
from . import duck as D
from .q_consolidate import DOWNLOADED, NL, _document_sql, _inputs
from .registry import query

# A link to an image by the length of the page's URL, read alike by both engines.
_ASSET_LINK = """concat('<a href="https://cdn.example/', length(url), '.png">')"""

# Headings looked for by the targeted audit (parameters of the query).
TARGETS = ["Notes", "Detail", "Good", "deeper"]


def _blocks(spark, sf):
    pages, hier, bases = _inputs(spark, sf)
    return C.consolidate(pages, hier, bases, DOWNLOADED)


def _doc_cte() -> str:
    """The consolidated-document SQL as a CTE named ``docs``."""
    return f"docs AS ({_document_sql(True)})"


_RECORDS = f"""
{_doc_cte()},
rec AS (
  SELECT site, part, k1, k2,
         string_split(CASE WHEN part = 0 THEN substr(block, 1, length(block) - 1)
                           ELSE {NL} || substr(block, 1, length(block) - 1) END, {NL}) AS lines
  FROM docs
), numbered AS (
  SELECT site, lines,
         coalesce(sum(len(lines)) OVER (PARTITION BY site ORDER BY part, k1, k2
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rec
), heads AS (
  SELECT site, CAST(before + i AS BIGINT) AS line_no, {D.py_strip('lines[i]')} AS text
  FROM (SELECT site, before, lines, generate_subscripts(lines, 1) AS i FROM numbered)
  WHERE starts_with({D.py_strip('lines[i]')}, '#')
)"""


@query("heading_audit", oracle=f"WITH {_RECORDS} SELECT site, line_no, text FROM heads")
def heading_audit(spark, sf):
    """Heading lines of every consolidated document with 1-based line numbers."""
    return LB.heading_audit(_blocks(spark, sf))


_TARGETS_SQL = " UNION ALL ".join(f"SELECT {D.q(t)} AS target" for t in TARGETS)


@query("target_heading_audit", oracle=f"""
WITH {_RECORDS}, t AS ({_TARGETS_SQL})
SELECT h.site, h.line_no, h.text, t.target FROM heads h JOIN t ON strpos(h.text, t.target) > 0""")
def target_heading_audit(spark, sf):
    return LB.target_heading_audit(LB.heading_audit(_blocks(spark, sf)), TARGETS)


@query("library_metadata", oracle=f"""
WITH {_doc_cte()}
SELECT site,
  max(CASE WHEN part = 0 THEN {D.py_strip("substr(split_part(block, chr(10), 1), 3)")} END) AS title,
  max(CASE WHEN part = 0 THEN regexp_extract(block, {D.q(D.SOURCE_LINE_RE)}, 1) END) AS source,
  CAST(sum(octet_length(encode(block))) + count(*) FILTER (WHERE part = 1) AS BIGINT) AS size
FROM docs GROUP BY site""")
def library_metadata(spark, sf):
    """Write every site's document to the shared folder, then list the library:
    title and source from each document's head, size from the file listing."""
    base = ensure_checkpoint_dir(spark)
    out = f"{base.rstrip('/')}/library-{uuid.uuid4().hex}"
    C.sink_documents(_blocks(spark, sf), out)
    lib = LB.library_metadata(spark, out, "*.txt", by_dir=True)
    return lib.select(F.regexp_extract("name", r"^site=(.*)$", 1).alias("site"), "title", "source",
                      F.col("size").cast("long").alias("size"))


@query("run_stats", oracle=f"""
WITH {_doc_cte()}, dom AS (
  SELECT site, count(*) FILTER (WHERE part = 1) AS pages_downloaded FROM docs GROUP BY site
), refs AS (
  SELECT site, count(DISTINCT ref) AS assets_downloaded FROM (
    SELECT site, unnest(regexp_extract_all(link, '(?i)href\\s*=\\s*"(https://cdn[.]example/[0-9]+[.]png)"', 1)) AS ref
    FROM (SELECT *, {_ASSET_LINK} AS link FROM ({CP.PAGES_SQL}))) GROUP BY site)
SELECT dom.site, pages_downloaded, coalesce(assets_downloaded, 0) AS assets_downloaded,
       CAST(12.5 AS DOUBLE) AS duration, pages_downloaded / CAST(12.5 AS DOUBLE) AS pages_per_second
FROM dom LEFT JOIN refs ON refs.site = dom.site""")
def run_stats(spark, sf):
    """Per site: pages written, distinct assets its pages refer to (each page
    gets a link by the length of its URL), duration (a parameter) and rate."""
    from .pipeline import run_stats as stats
    pages, _, _ = _inputs(spark, sf)
    linked = pages.select("site", "url", F.expr(_ASSET_LINK).alias("content"), F.lit(None).cast("string").alias("html"))
    return stats(_blocks(spark, sf), A.asset_refs(linked), 12.5)


@query("library_newest", oracle=f"""
WITH {_doc_cte()}, sizes AS (
  SELECT site AS document,
    max(CASE WHEN part = 0 THEN {D.py_strip("substr(split_part(block, chr(10), 1), 3)")} END) AS title,
    max(CASE WHEN part = 0 THEN regexp_extract(block, '\\*\\*Source:\\*\\* (https?://[^[:space:]]+)', 1) END) AS source,
    CAST(sum(octet_length(encode(block))) + count(*) FILTER (WHERE part = 1) AS BIGINT) AS size, length(site) > 12 AS again
  FROM docs GROUP BY site)
SELECT document, title, source, size, CASE WHEN again THEN TIMESTAMP '2024-03-02 08:00:00' ELSE TIMESTAMP '2024-03-01 08:00:00' END AS modified,
       TIMESTAMP '2024-03-01 08:00:00' AS created, row_number() OVER (ORDER BY again DESC, document) - 1 AS newest
FROM sizes""")
def library_newest(spark, sf):
    """Every site's document appended to a library table, those of longer names
    once more a day later; the listing, newest first, from its manifest."""
    blocks = cut_lineage(_blocks(spark, sf))
    library = DocumentTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/library-{uuid.uuid4().hex}")
    library.add(blocks, 0, "2024-03-01 08:00:00")
    library.add(blocks.where(F.length("site") > 12), 1, "2024-03-02 08:00:00")
    return library.metadata()


@query("title_mentions", oracle=f"""
WITH {_RECORDS}, t AS (SELECT DISTINCT substr(text, 1, 12) AS target FROM documents WHERE text IS NOT NULL AND length(text) >= 6)
SELECT h.site, h.line_no, h.text, t.target FROM heads h JOIN t ON strpos(h.text, t.target) > 0""")
def title_mentions(spark, sf):
    """Headings that hold the beginning of any document of the corpus."""
    docs = read_table(spark, sf, "documents", "text").where("text IS NOT NULL AND length(text) >= 6")
    return LB.target_heading_audit(LB.heading_audit(_blocks(spark, sf)), docs.select(F.left("text", F.lit(12)).alias("target")).distinct())
