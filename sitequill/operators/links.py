"""Link discovery over extracted anchors: the link graph, navigation links and
repository detection. All windows are partitioned by page, so their size is
bounded by one page's anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import urls as U
from . import extract as X

NAV_CUTOFF = 5  # stop after the selector at which more than this many links are held
TITLE_MAX = 100


def link_edges(pages: DataFrame) -> DataFrame:
    """Distinct same-host links per page: (page_id, site, to_url).

    Resolved, blocklisted paths dropped, ``#``/``?`` cut and one trailing
    slash removed. The page URL rides along the extraction pass (no join back).
    """
    a = X.anchors(pages.select("page_id", "url", "html"), keep_url=True)
    kept = a.where((U.url_netloc("abs_url") == U.url_netloc("url")) & ~P.link_blocked("abs_url"))
    return kept.select("page_id", U.site_of("url").alias("site"), U.clean_link_url("abs_url").alias("to_url")).distinct()


def nav_links(pages: DataFrame) -> DataFrame:
    """Navigation links of each page: (page_id, pos, url, title).

    Selectors are taken in rank order; the walk stops after the selector at
    which the running total of valid links exceeds 5. Links are then
    de-duplicated by URL (first wins). A page with no link yields itself as
    ``Main Page``. One extraction pass; every window is partitioned by page
    (one shuffle), so its size is one page's links.
    """
    nav = X.nav_anchors(pages.select("page_id", "url", "html"), keep_url=True)
    valid = nav.where((F.col("href") != "") & (F.col("text") != "")
                      & P.valid_page_url("abs_url", U.url_netloc("url"))).select(
        "page_id", "sel_rank", "pos", "abs_url", "text", F.lit(1).alias("real"))
    # One sentinel per page (no HTML read) stands for the "Main Page" fallback;
    # it survives only when the page has no real link.
    sentinel = pages.select("page_id", F.lit(1 << 30).alias("sel_rank"), F.lit(0).alias("pos"),
                            F.col("url").alias("abs_url"), F.lit("Main Page").alias("text"), F.lit(0).alias("real"))
    rows = valid.unionByName(sentinel)
    upto = Window.partitionBy("page_id").orderBy("sel_rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("page_id", "sel_rank")
    held_before = F.sum("real").over(upto) - F.sum("real").over(same)
    taken = rows.withColumn("held_before", held_before).where(
        (F.col("real") == 0) | (F.col("held_before") <= NAV_CUTOFF))
    page = Window.partitionBy("page_id")
    kept = taken.withColumn("n_real", F.sum("real").over(page)).where((F.col("real") == 1) | (F.col("n_real") == 0))
    first = Window.partitionBy("page_id", "abs_url").orderBy("sel_rank", "pos")
    dedup = kept.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1)
    order = Window.partitionBy("page_id").orderBy("sel_rank", "pos")
    return dedup.select(
        "page_id", (F.row_number().over(order) - 1).alias("pos"), F.col("abs_url").alias("url"),
        F.when(F.col("real") == 1, F.left(F.col("text"), F.lit(TITLE_MAX))).otherwise(F.col("text")).alias("title"))


def detect_repo(pages: DataFrame) -> DataFrame:
    """Per site, the first repository link (``github.com`` with ``/blob/``)
    in selector-rank then page then position order -> ``<prefix>.git``."""
    r = X.repo_anchors(pages.select("page_id", "url", "html"), keep_url=True).where(
        F.col("href").contains("github.com") & F.col("href").contains("/blob/")
    ).withColumn("site", U.site_of("url"))
    best = r.groupBy("site").agg(F.min(F.struct("sel_rank", "page_id", "pos", "href")).alias("k"))
    return best.select("site", F.concat(F.substring_index(F.col("k.href"), "/blob/", 1), F.lit(".git")).alias("repo_url"))
