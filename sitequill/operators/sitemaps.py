"""Sitemap discovery: find sitemap bodies, parse them, follow indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut_lineage

# Sitemap locations tried under the site root.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap-pages.xml", "/sitemap_index.xml"]

SITEMAP_SCHEMA = "url array<struct<loc: string>>, sitemap array<struct<loc: string>>"


def scan_sitemaps(fetches: DataFrame) -> DataFrame:
    """Accepted sitemap responses at the well-known paths: (site, url, body)."""
    return fetches.where(
        (F.col("status") == 200)
        & U.url_path("url").isin(*SITEMAP_PATHS)
        & (F.col("body").contains("<urlset") | F.col("body").contains("<sitemapindex"))
    ).select("site", "url", "body")


def parse_sitemap(bodies: DataFrame) -> DataFrame:
    """``<url><loc>`` and ``<sitemap><loc>`` entries: (site, sitemap_url, kind, loc).

    ``from_xml`` in PERMISSIVE mode: a malformed body yields no rows instead of
    failing the job (the reference skips such sitemaps).
    """
    x = bodies.select("site", F.col("url").alias("sitemap_url"),
                      F.from_xml("body", SITEMAP_SCHEMA, {"mode": "PERMISSIVE"}).alias("x"))

    def entries(field: str, kind: str):
        locs = F.coalesce(F.col(f"x.{field}.loc"), F.array().cast("array<string>"))
        return F.transform(locs, lambda l: F.struct(F.lit(kind).alias("kind"), F.trim(l).alias("loc")))

    # One generator over both lists: a body is parsed once.
    both = x.select("site", "sitemap_url", F.inline(F.concat(entries("url", "url"), entries("sitemap", "sitemap"))))
    return both.where(F.col("loc").isNotNull())


def resolve_sitemap_index(fetches: DataFrame, start: DataFrame, distinct: bool = True) -> DataFrame:
    """Page URLs reachable from ``start(site, url)`` sitemaps.

    Frontier loop: parse the frontier's bodies, collect page locs, and follow
    child sitemaps not seen before, until no new one is found; a cycle ends
    because its sitemaps are in the seen set, and no depth is too deep. Parsed
    rows and frontiers are written each round, so the seen set is a union of
    leaf tables and no plan grows with the depth. The driver only tests the
    frontier for emptiness. Returns (site, url), distinct unless
    ``distinct=False`` keeps every listing.
    """
    bodies = fetches.where((F.col("status") == 200) & (F.col("kind") == "sitemap")).select("site", "url", "body")
    frontier = cut_lineage(start.select("site", "url").distinct())
    seen, found = frontier, None
    while True:
        # Feeds both the page URLs and the next frontier.
        parsed = cut_lineage(parse_sitemap(frontier.join(bodies, ["site", "url"])))
        locs = parsed.where(F.col("kind") == "url").select("site", F.col("loc").alias("url"))
        found = locs if found is None else found.unionByName(locs)
        children = parsed.where(F.col("kind") == "sitemap").select("site", F.col("loc").alias("url")).distinct()
        frontier = cut_lineage(children.join(seen, ["site", "url"], "left_anti"))
        if frontier.isEmpty():
            return found.distinct() if distinct else found
        seen = seen.unionByName(frontier)
