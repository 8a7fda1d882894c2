"""Consolidation: reading order, content de-duplication, heading re-levelling,
section breaks and the per-site document.

Scale notes
-----------
* A site's document is never built as one value. It is a set of block rows
  ``(site, part, k1, k2, block)``: the header (part 0) and one block per kept
  page (part 1), ordered by the reading-order key ``(k1, k2)``. The document is
  the blocks in key order joined by one newline; ``sink_documents`` writes it
  with a range-partitioned, sorted write, so one site may span many tasks.
* Re-levelling works on each page's own line array (no shuffle).
* Hierarchy lookup and de-duplication run on thin rows that carry the md5 of
  the content; the content is attached once, by (site, url, md5). A duplicate
  group is combined before the shuffle, and the per-site flag is joined by
  (site, salt), so a large site spreads over many tasks.
* The only site-wide window is over pages whose hierarchy entry carries a
  section; the hierarchy comes from one sidebar page, which bounds that set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import urls as U
from ..session import cut_lineage
from .scan import neighbor_value

UNMAPPED_ORDER = 999_999
#: Characters of a document that the library listing looks at.
PREVIEW_CHARS = 500
#: Parts into which each site's pages are dealt where only the site matters.
SITE_SALTS = 64
TOOL_LINE = "*Compiled with sitequill*"

# Host suffixes removed (in this order) to form a document title.
TITLE_HOST_SUFFIXES = [".gitbook.io", ".com"]

# Title words of the heuristic reading order.
INTRO_WORDS = ["readme", "introduction", "intro", "start", "index"]      # +1000
OVERVIEW_WORDS = ["getting started", "quick start", "overview"]         # +900

WS_CLASS = TX.PY_WHITESPACE
HEAD_RE = r"(?s)^(#+)[" + WS_CLASS + r"]+(.*)"


# -- reading order -------------------------------------------------------------

def heuristic_score(title: Column, url: Column) -> Column:
    """Title-based score; higher reads earlier.

    +1000 for an intro word, +900 for an overview word (substrings of the
    lower-cased title), +800 minus the first number in the title, +max(0, 100 -
    words in the title), +max(0, 50 - '/'-separated parts of the URL).
    """
    t = F.lower(title)
    intro = F.lit(False)
    for w in INTRO_WORDS:
        intro = intro | t.contains(w)
    over = F.lit(False)
    for w in OVERVIEW_WORDS:
        over = over | t.contains(w)
    digits = F.regexp_extract(t, r"([0-9]+)", 1)
    num = F.when(digits != "", F.lit(800).cast("decimal(38,0)") - digits.try_cast("decimal(38,0)")).otherwise(F.lit(0))
    n_words = F.size(F.filter(F.split(t, "[" + WS_CLASS + "]+"), lambda x: x != ""))
    segs = F.size(F.split(url, "/", -1))
    return (
        F.when(intro, 1000).otherwise(0) + F.when(over, 900).otherwise(0)
        + F.coalesce(num, F.lit(0)) + F.greatest(F.lit(0), 100 - n_words) + F.greatest(F.lit(0), 50 - segs)
    ).cast("decimal(38,0)")


def hierarchy_lookup(pages: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Left lookup page.url -> hierarchy; a ``.md`` URL retries without it.

    Two equi-joins and ``coalesce`` (an OR join would be a nested loop). A URL
    that is not retried gets a key of its own that no hierarchy entry has, so
    these rows spread over all tasks instead of meeting at one null key.
    """
    h = hierarchy.select(F.col("site").alias("h_site"), F.col("url").alias("h_url"),
                         F.struct(F.col("level").alias("h_level"), F.col("ord").alias("h_ord"),
                                  F.col("section").alias("h_section")).alias("hit"))
    h1 = h.select(F.col("h_site").alias("s1"), F.col("h_url").alias("u1"), F.col("hit").alias("hit1"))
    h2 = h.select(F.col("h_site").alias("s2"), F.col("h_url").alias("u2"), F.col("hit").alias("hit2"))
    nomd = F.when(F.col("url").endswith(".md"), F.expr("substring(url, 1, length(url) - 3)")).otherwise(
        F.concat(F.lit("\0"), F.coalesce("url", F.lit(""))))
    p = pages.withColumn("_url_nomd", nomd)
    j = p.join(h1, (F.col("site") == F.col("s1")) & (F.col("url") == F.col("u1")), "left")
    j = j.join(h2, (F.col("site") == F.col("s2")) & (F.col("_url_nomd") == F.col("u2")), "left")
    hit = F.coalesce("hit1", "hit2")
    return j.select(*pages.columns, hit.getField("h_level").alias("h_level"),
                    hit.getField("h_ord").alias("h_ord"), hit.getField("h_section").alias("h_section"))


# -- heading re-levelling --------------------------------------------------------

def _heads(content: Column) -> Column:
    """Per line: (idx, line, heading level or 0, stripped heading text)."""
    return F.transform(F.split(content, "\n", -1), lambda l, i: F.struct(
        i.alias("idx"),
        l.alias("line"),
        F.length(F.regexp_extract(l, HEAD_RE, 1)).alias("lvl"),
        TX.py_strip(F.regexp_extract(l, HEAD_RE, 2)).alias("txt"),
    ))


def relevel(df: DataFrame, content: str, target: str, title: str, out: str,
            tested_rule: bool = False) -> DataFrame:
    """Add ``out``: ``content`` with every heading shifted so the page's top
    heading sits one below its title.

    shift = (target + 1) - min level; each heading -> ``max(1, level + shift)``
    ``#`` + stripped text; the first heading is dropped when it matches the page
    title (folded equality or containment either way). A page without headings
    is returned unchanged. ``tested_rule`` selects the variant in which a
    title-duplicate ``h1`` maps to the page level and no whitespace clean-up
    follows.

    Linear per page: the line array is built once in its own projection, and
    the per-page values (drop flag, shift, first heading index) reach the line
    lambda through ``zip_with`` with ``array_repeat`` -- an expression written
    inside the lambda would be evaluated again for every line.
    """
    cols = df.columns
    d = df.select(*cols, _heads(F.col(content)).alias("_heads"))
    hs = F.filter(F.col("_heads"), lambda h: h["lvl"] > 0)
    first = F.try_element_at(hs, F.lit(1))
    min_level = F.array_min(F.transform(hs, lambda h: h["lvl"]))
    ct = TX.fold_for_match(first["txt"])
    cl = TX.fold_for_match(F.col(title))
    similar = (ct == cl) | (F.instr(ct, cl) > 0) | (F.instr(cl, ct) > 0)
    tgt = F.col(target)
    if tested_rule:
        dupe = first.isNotNull() & similar
        base = F.when((min_level == 1) & dupe, tgt).otherwise(tgt + 1)
    else:
        dupe = first.isNotNull() & (F.coalesce(F.col(title), F.lit("")) != "") & similar
        base = tgt + 1
    meta = F.struct(F.coalesce(dupe, F.lit(False)).alias("dupe"), (base - min_level).alias("shift"),
                    F.coalesce(first["idx"], F.lit(-1)).alias("first"))
    lines = F.zip_with(F.col("_heads"), F.array_repeat(meta, F.size("_heads")), lambda h, m: F.when(
        h["lvl"] > 0,
        F.when(m["dupe"] & (h["idx"] == m["first"]), F.lit(None).cast("string")).otherwise(
            F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), h["lvl"] + m["shift"])), F.lit(" "), h["txt"])),
    ).otherwise(h["line"]))
    joined = F.array_join(F.array_compact(lines), "\n")
    processed = joined if tested_rule else TX.py_strip(TX.squeeze_newlines(joined))
    return d.select(*cols, F.when(min_level.isNull(), F.col(content)).otherwise(processed).alias(out))


def min_heading(content: Column) -> Column:
    """(min_level, first_text): 99 and '' when the page has no heading."""
    heads = F.transform(F.split(content, "\n", -1), lambda l: F.struct(
        F.length(F.regexp_extract(l, HEAD_RE, 1)).alias("lvl"),
        TX.py_strip(F.regexp_extract(l, HEAD_RE, 2)).alias("txt"),
    ))
    hs = F.filter(heads, lambda h: h["lvl"] > 0)
    return F.struct(
        F.coalesce(F.array_min(F.transform(hs, lambda h: h["lvl"])), F.lit(99)).alias("min_level"),
        F.coalesce(F.try_element_at(hs, F.lit(1))["txt"], F.lit("")).alias("first_text"),
    )


# -- pipeline -------------------------------------------------------------------

def order_pages(pages: DataFrame, hierarchy: DataFrame | None) -> DataFrame:
    """Attach level/section and the reading-order key (k1, k2).

    With a hierarchy: k1 = hierarchy order (999999 unmapped). Without: k1 =
    -score. k2 = url breaks ties (the reference's ties follow fetch order).
    """
    if hierarchy is not None:
        # A site without any hierarchy entry falls back to the heuristic order.
        # One flag per site and salt: a large site's pages spread over the salts.
        mapped_sites = (hierarchy.select(F.col("site").alias("_hs")).distinct()
                        .select("_hs", F.explode(F.sequence(F.lit(0), F.lit(SITE_SALTS - 1))).alias("_hn")))
        p = hierarchy_lookup(pages, hierarchy).withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SITE_SALTS)).cast("int"))
        p = p.join(mapped_sites, (p.site == mapped_sites._hs) & (p._salt == mapped_sites._hn), "left")
        k1 = F.when(F.col("_hs").isNotNull(),
                    F.coalesce(F.col("h_ord").cast("decimal(38,0)"), F.lit(UNMAPPED_ORDER).cast("decimal(38,0)"))
                    ).otherwise(-heuristic_score(F.col("title"), F.col("url")))
        return p.select(*pages.columns, "h_level", "h_section", k1.alias("k1"), F.col("url").alias("k2"))
    return pages.select(*pages.columns, F.lit(None).cast("int").alias("h_level"),
                        F.lit(None).cast("string").alias("h_section"),
                        (-heuristic_score(F.col("title"), F.col("url"))).alias("k1"), F.col("url").alias("k2"))


def kept_pages(pages: DataFrame, hierarchy: DataFrame | None) -> DataFrame:
    """Drop blank pages; keep the first page per (site, content md5) in reading
    order: (site, url, title, h_level, h_section, k1, k2, md5).

    Only thin rows are looked up, shuffled and aggregated; the content stays
    where it is and is represented by its md5. The minimum over the
    reading-order key has a map-side partial, so each task ships one row per
    duplicate group, however hot.
    """
    thin = pages.where(~TX.is_blank("content")).select("site", "url", "title", TX.content_md5("content").alias("md5"))
    ordered = order_pages(thin, hierarchy)
    first = F.min(F.struct("k1", "k2", "url", "title", "h_level", "h_section")).alias("r")
    firsts = ordered.groupBy("site", "md5").agg(first)
    return firsts.select("site", "r.url", "r.title", "r.h_level", "r.h_section", "r.k1", "r.k2", "md5")


def attach_content(kept: DataFrame, pages: DataFrame) -> DataFrame:
    """``kept`` with the content of its pages: the one shuffle of the content,
    on (site, url, md5). Equal rows of ``pages`` give one row."""
    bodies = pages.where(~TX.is_blank("content")).select(
        F.col("site").alias("_s"), F.col("url").alias("_u"), TX.content_md5("content").alias("_m"), "content")
    j = kept.join(bodies, (F.col("site") == F.col("_s")) & (F.col("url") == F.col("_u")) & (F.col("md5") == F.col("_m")))
    rest = [F.first(c).alias(c) for c in (*[c for c in kept.columns if c not in ("site", "url", "md5")], "content")]
    return j.groupBy("site", "url", "md5").agg(*rest)


def section_breaks(kept: DataFrame) -> DataFrame:
    """Pages before which ``## <section>`` is emitted: section set and different
    from the last non-null section of an earlier kept page.

    The previous section comes from ``scan.neighbor_value`` over the pages that
    carry a section, so no window ever holds a whole site.
    """
    s = kept.where(F.col("h_section").isNotNull()).select("site", "k1", "k2", "url", "h_section")
    s = neighbor_value(s, "site", ["k1", "k2"], "h_section", "prev")
    return s.where(F.col("prev").isNull() | (F.col("prev") != F.col("h_section"))).select(
        "site", "k1", "k2", "url", F.col("h_section").alias("section"))


def page_blocks(kept: DataFrame, breaks: DataFrame, tested_rule: bool = False) -> DataFrame:
    """One block per kept page: optional section break, heading, body, rule."""
    title = TX.clean_title("title")
    title = F.when(F.col("title").contains("|"), title).otherwise(F.col("title"))
    target = F.coalesce(F.col("h_level") + 1, F.lit(2))
    b = kept.join(breaks.select("site", "k1", "k2", "section"), ["site", "k1", "k2"], "left")
    b = b.select("site", "k1", "k2", "section", "content", target.alias("_tgt"), title.alias("_title"))
    b = relevel(b, "content", "_tgt", "_title", "_body", tested_rule)
    target, title, body = F.col("_tgt"), F.col("_title"), F.col("_body")
    page = F.concat(F.repeat(F.lit("#"), F.greatest(target, F.lit(0))), F.lit(" "), title, F.lit("\n\n"), body)
    unit = F.concat(
        F.when(F.col("section").isNotNull(), F.concat(F.lit("\n## "), F.col("section"), F.lit("\n\n"))).otherwise(F.lit("")),
        page, F.lit("\n"), F.lit("\n---\n"),
    )
    return b.select("site", F.lit(1).alias("part"), "k1", "k2", TX.squeeze_newlines(unit).alias("block"))


def site_title(base_url: Column, section_path: str | None) -> Column:
    host = U.url_netloc(base_url)
    for suffix in TITLE_HOST_SUFFIXES:
        host = F.replace(host, F.lit(suffix), F.lit(""))
    t = TX.py_title(host)
    if section_path:
        t = F.concat(t, F.lit(" - " + section_path.replace("/", " / ").title()))
    return t


def document_header(pages: DataFrame, base_urls: DataFrame, downloaded: str,
                    section_path: str | None = None) -> DataFrame:
    """Header block per site; ``Pages`` counts every page before blanks and duplicates are dropped."""
    counts = pages.groupBy("site").agg(F.count("*").alias("n_pages"))
    h = counts.join(base_urls, "site")
    sec = f"**Section:** {section_path}  \n" if section_path else ""
    header = F.concat(
        F.lit("# "), site_title(F.col("base_url"), section_path), F.lit("\n\n" + TOOL_LINE + "\n\n**Source:** "),
        F.col("base_url"), F.lit("  \n**Pages:** "), F.col("n_pages").cast("string"),
        F.lit("  \n**Downloaded:** " + downloaded + "  \n" + sec + "\n---\n"),
    )
    return h.select("site", F.lit(0).alias("part"), F.lit(None).cast("decimal(38,0)").alias("k1"),
                    F.lit(None).cast("string").alias("k2"), header.alias("block"))


def consolidate(pages: DataFrame, hierarchy: DataFrame | None, base_urls: DataFrame, downloaded: str,
                section_path: str | None = None, tested_rule: bool = False) -> DataFrame:
    """Blocks of every site's document: (site, part, k1, k2, block).

    ``pages``: (site, url, title, content); ``hierarchy``: (site, url, level,
    ord, section) or None for the heuristic order; ``base_urls``: (site, base_url).
    """
    pages = pages.select("site", "url", "title", "content")
    # The de-duplicated page set feeds both the section scan and the blocks:
    # written once, thin, so the ordering joins and the md5 aggregate run once.
    kept = cut_lineage(kept_pages(pages, hierarchy))
    breaks = section_breaks(kept)
    blocks = page_blocks(attach_content(kept, pages), breaks, tested_rule)
    return document_header(pages, base_urls, downloaded, section_path).unionByName(blocks)


def sink_documents(blocks: DataFrame, path: str, n_partitions: int | None = None) -> None:
    """Write each site's document as text under ``site=<site>/``.

    Blocks are range-partitioned on (site, part, k1, k2) and sorted within
    partitions, so part files of a site concatenate in reading order. Each
    block is written as one record followed by a newline; blocks therefore
    carry the newline that joins them: header without its last newline,
    page blocks as ``\\n`` + block without its last newline. The first
    characters of every document go to a small table (``heads_path``) for the
    library listing.
    """
    rec = F.when(F.col("part") == 0, F.expr("substring(block, 1, length(block) - 1)")).otherwise(
        F.concat(F.lit("\n"), F.expr("substring(block, 1, length(block) - 1)")))
    out = blocks.select("site", "part", "k1", "k2", rec.alias("value"))
    keys = ("site", "part", "k1", "k2")
    ranged = out.repartitionByRange(n_partitions, *keys) if n_partitions else out.repartitionByRange(*keys)
    (ranged.sortWithinPartitions("site", "part", "k1", "k2")
        .select("site", "value")
        .write.mode("overwrite").partitionBy("site").text(path))
    heads = out.where(F.col("part") == 0).select("site", F.left("value", F.lit(PREVIEW_CHARS)).alias("head"))
    heads.write.mode("overwrite").parquet(heads_path(path))


def heads_path(path: str) -> str:
    """Where the heads of the documents under ``path`` are written."""
    return f"{path.rstrip('/')}-heads"
