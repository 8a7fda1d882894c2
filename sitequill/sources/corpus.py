"""Page records and a hierarchy derived from the driver's ``documents`` and
``labels`` tables, for the consolidation jobs.

* ``site`` is the document's ``source``; the URL is built from source, lang and
  id (German pages carry a ``.md`` suffix, which the hierarchy lookup must
  retry without);
* title and headings are built from the text so that title-duplicate
  headings, all heading depths and exact duplicate bodies all occur;
* the hierarchy holds the labelled documents: level from the labels, order
  from the document length, section from the quality label.

Each builder has a DuckDB twin (``*_SQL``) used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

NL = "chr(10)"

PAGES_SQL = f"""
SELECT source AS site,
  'https://' || source || '.example.com/' || lang || '/' || CAST(doc_id AS VARCHAR)
    || CASE WHEN lang = 'de' THEN '.md' ELSE '' END AS url,
  split_part(text, ' ', 1) || CASE WHEN lang = 'es' THEN ' | ' || source ELSE '' END AS title,
  CASE lang
    WHEN 'en' THEN '# ' || split_part(text, ' ', 1) || {NL} || text
    WHEN 'de' THEN '## Notes' || {NL} || text || {NL} || '### Detail' || {NL} || 'end'
    WHEN 'fr' THEN text
    ELSE '#### ' || source || {NL} || {NL} || {NL} || {NL} || text || {NL} || '##### deeper'
  END AS content
FROM documents"""

HIERARCHY_SQL = """
SELECT d.source AS site,
  'https://' || d.source || '.example.com/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) AS url,
  split_part(d.text, ' ', 1) AS title,
  1 + l.quality + l.toxic AS level,
  d.n_chars AS ord,
  CASE WHEN l.toxic = 1 THEN NULL WHEN l.quality = 1 THEN 'Good' ELSE 'Other' END AS section
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""

BASE_URLS_SQL = "SELECT DISTINCT source AS site, 'https://' || source || '.example.com' AS base_url FROM documents"


def corpus_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    nl = F.lit("\n")
    first_word = F.split_part("text", F.lit(" "), F.lit(1))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"),
                   F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", F.lit(".md")).otherwise(F.lit("")))
    title = F.concat(first_word, F.when(F.col("lang") == "es", F.concat(F.lit(" | "), "source")).otherwise(F.lit("")))
    content = (
        F.when(F.col("lang") == "en", F.concat(F.lit("# "), first_word, nl, "text"))
        .when(F.col("lang") == "de", F.concat(F.lit("## Notes"), nl, "text", nl, F.lit("### Detail"), nl, F.lit("end")))
        .when(F.col("lang") == "fr", F.col("text"))
        .otherwise(F.concat(F.lit("#### "), "source", F.lit("\n\n\n\n"), "text", nl, F.lit("##### deeper")))
    )
    return d.select(F.col("source").alias("site"), url.alias("url"), title.alias("title"), content.alias("content"))


def corpus_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")
    lab = read_table(spark, sf, "labels", "doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    return j.select(
        F.col("source").alias("site"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"),
                 F.col("doc_id").cast("string")).alias("url"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("title"),
        (1 + F.col("quality") + F.col("toxic")).alias("level"),
        F.col("n_chars").alias("ord"),
        F.when(F.col("toxic") == 1, F.lit(None).cast("string"))
        .when(F.col("quality") == 1, F.lit("Good")).otherwise(F.lit("Other")).alias("section"),
    )


def corpus_base_urls(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", "source")
    return d.select(F.col("source").alias("site")).distinct().select(
        "site", F.concat(F.lit("https://"), "site", F.lit(".example.com")).alias("base_url"))
