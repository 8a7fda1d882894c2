"""The ``fetches`` relation: captured response bodies keyed by URL.

``fetches(site, url, status, body, kind)`` with kind in {html, md, sitemap}.
The HTML rows are the driver's ``pages`` table. Markdown and sitemap rows are
derived from those pages by deterministic Spark SQL, so they grow with the
data:

* pages in English (``lang="en"``) serve ``<url>.md``, a Markdown body built
  from the page's ``<title>`` and ``<article>`` text;
* pages in German serve an HTML body at ``<url>.md`` (a soft 404 that the probe
  must reject) and Markdown at ``<url>/README.md``;
* each site serves ``/sitemap.xml`` (an index that also lists itself: a cycle)
  and one ``/sitemap-<k>.xml`` urlset per chunk of at most ``urls_per_sitemap``
  page URLs, the limit of the sitemap protocol.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from .tables import read_table

URLS_PER_SITEMAP = 50_000

LANG_RE = r'<html lang="([^"]*)"'
TITLE_TAG_RE = r"<title>([^<]*)</title>"
ARTICLE_RE = r"(?s)<article>(.*)</article>"


def xml_escape(c: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_fetches(pages: DataFrame) -> DataFrame:
    return pages.select(
        U.site_of("url").alias("site"),
        "url",
        F.lit(200).alias("status"),
        F.col("html").alias("body"),
        F.lit("html").alias("kind"),
    )


def markdown_body(html: F.Column) -> F.Column:
    """``# <title>`` + blank line + the article's text with tags removed."""
    text = F.regexp_replace(F.regexp_extract(html, ARTICLE_RE, 1), "<[^>]+>", " ")
    return F.concat(F.lit("# "), F.regexp_extract(html, TITLE_TAG_RE, 1), F.lit("\n\n"), text)


def markdown_fetches(pages: DataFrame) -> DataFrame:
    lang = F.regexp_extract("html", LANG_RE, 1)
    base = pages.select("url", "html", lang.alias("lang")).where(F.col("lang").isin("en", "de"))
    u = U.lookup_key("url")
    md = base.select(
        U.site_of("url").alias("site"),
        F.concat(u, F.lit(".md")).alias("url"),
        F.when(F.col("lang") == "en", markdown_body(F.col("html"))).otherwise(F.col("html")).alias("body"),
    )
    readme = base.where(F.col("lang") == "de").select(
        U.site_of("url").alias("site"),
        F.concat(u, F.lit("/README.md")).alias("url"),
        markdown_body(F.col("html")).alias("body"),
    )
    return md.unionByName(readme).select(
        "site", "url", F.lit(200).alias("status"), "body", F.lit("md").alias("kind")
    )


def sitemap_fetches(pages: DataFrame, urls_per_sitemap: int = URLS_PER_SITEMAP) -> DataFrame:
    """One urlset body per (site, chunk) and one index body per site.

    Chunks are formed by hashing the URL: no ordering window over a whole site
    is needed, and each body is bounded by the protocol limit on average.
    """
    site_pages = pages.select(U.site_of("url").alias("site"), U.site_root("url").alias("root"), "url")
    counts = site_pages.groupBy("site").agg(F.count("*").alias("n"), F.min("root").alias("root"))
    chunks = counts.select(
        "site", "root", F.greatest(F.lit(1), F.ceil(F.col("n") / urls_per_sitemap)).cast("int").alias("n_chunks")
    )
    entries = (
        site_pages.join(chunks.select("site", "n_chunks"), "site")
        .select("site", "url", F.pmod(F.xxhash64("url"), F.col("n_chunks")).alias("chunk"))
    )
    urlsets = (
        entries.groupBy("site", "chunk")
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc>"), xml_escape(F.col("url")), F.lit("</loc></url>")))), "")
             .alias("locs"))
        .join(chunks.select("site", "root"), "site")
        .select(
            "site",
            F.concat("root", F.lit("/sitemap-"), F.col("chunk").cast("string"), F.lit(".xml")).alias("url"),
            F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                     "locs", F.lit("</urlset>")).alias("body"),
        )
    )
    index = chunks.select(
        "site",
        F.concat("root", F.lit("/sitemap.xml")).alias("url"),
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.array_join(
                F.transform(
                    F.sequence(F.lit(0), F.col("n_chunks") - 1),
                    lambda k: F.concat(F.lit("<sitemap><loc>"), F.col("root"), F.lit("/sitemap-"), k.cast("string"),
                                       F.lit(".xml</loc></sitemap>")),
                ),
                "",
            ),
            F.lit("<sitemap><loc>"), F.col("root"), F.lit("/sitemap.xml</loc></sitemap></sitemapindex>"),
        ).alias("body"),
    )
    return urlsets.unionByName(index).select(
        "site", "url", F.lit(200).alias("status"), "body", F.lit("sitemap").alias("kind")
    )


def build_fetches(spark: SparkSession, sf_dir: str, kinds=("html", "md", "sitemap")) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "url", "html")
    parts = []
    if "html" in kinds:
        parts.append(html_fetches(pages))
    if "md" in kinds:
        parts.append(markdown_fetches(pages))
    if "sitemap" in kinds:
        parts.append(sitemap_fetches(pages.select("url")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_WRITTEN: dict[tuple[str, str], str] = {}


def fetch_table(spark: SparkSession, sf_dir: str, kinds=("html", "md", "sitemap")) -> DataFrame:
    """``fetches`` as a stored table, as production has it.

    The derived Markdown and sitemap rows are written once per session to the
    shared checkpoint folder, partitioned by ``kind`` (readers prune
    partitions); HTML rows stay a projection of ``pages`` (never copied).
    """
    from ..session import ensure_checkpoint_dir  # local import: avoid a cycle at package import

    pages = read_table(spark, sf_dir, "pages", "url", "html")
    derived_kinds = [k for k in kinds if k != "html"]
    parts = [html_fetches(pages)] if "html" in kinds else []
    if derived_kinds:
        key = (spark.sparkContext.applicationId, sf_dir)
        path = _WRITTEN.get(key)
        if path is None:
            base = ensure_checkpoint_dir(spark).rstrip("/")
            path = f"{base}/fetches-{uuid.uuid4().hex}"
            (markdown_fetches(pages).unionByName(sitemap_fetches(pages.select("url")))
             .write.mode("overwrite").partitionBy("kind").parquet(path))
            _WRITTEN[key] = path
        stored = spark.read.parquet(path).where(F.col("kind").isin(*derived_kinds))
        parts.append(stored.select("site", "url", "status", "body", "kind"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
