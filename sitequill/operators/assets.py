"""Asset references: extraction, inventory with file-name collisions, and
rewriting of Markdown image links to local files. All Catalyst expressions
except ``urljoin`` for relative references (distinct pairs only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as TX
from ..functions import urls as U
from ..functions.resolve import resolve_pairs
from ..session import cut_lineage

# Reference patterns (case-insensitive) and the group holding the
# URL. An image tag's source is one of the src attributes.
ASSET_PATTERNS = [
    (r"!\[([^\]]*)\]\(([^)]+)\)", 2),                                   # Markdown image
    (r"src\s*=\s*[\"']([^\"']+)[\"']", 1),                               # any src attribute
    (r"\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]\(([^)]+)\)", 2),          # Markdown link
]
# HTML link: the attribute with its value, quoted or bare.
HREF_PATTERN = r"href\s*=\s*(?:[\"'][^\"']*[\"']|[^\s>]+)"

EXT_GROUP = "|".join(e[1:] for e in P.ASSET_EXTENSIONS)
# Markdown image whose URL path ends in an asset extension: alt, file name.
REWRITE_RE = (r"!\[(.*?)\]\((?:[^)]*/)?([^/?#)]+\.(?i:" + EXT_GROUP + r"))(?:[?#][^)]*)?\)")


def reference_strings(text: Column) -> Column:
    """All candidate reference strings of a text (array, Python-stripped)."""
    parts = [F.regexp_extract_all(text, F.lit("(?i)" + p), g) for p, g in ASSET_PATTERNS]
    links = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + HREF_PATTERN), 0), _attribute_value)
    return F.transform(F.flatten(F.array(*parts, links)), lambda r: TX.py_strip(r))


def _attribute_value(attribute: Column) -> Column:
    """Value of a ``name = value`` match without its quotes."""
    value = F.regexp_replace(attribute, r"^[^=]*=\s*", "")
    return F.regexp_replace(value, r"^[\"']([^\"']*)[\"']$", "$1")


def asset_refs(pages: DataFrame) -> DataFrame:
    """Distinct asset URLs per site from each page's ``content`` + ``html``.

    pages(site, url, content, html) -> (site, asset_url).
    """
    text = F.concat(F.coalesce("content", F.lit("")), F.coalesce("html", F.lit("")))
    refs = pages.select("site", F.col("url").alias("base"), F.explode(reference_strings(text)).alias("ref"))
    # The references (far smaller than the HTML) are read by both resolution
    # branches: computed once, so the pages are scanned once.
    refs = cut_lineage(refs.where(~P.skip_asset_url("ref")).distinct())
    resolved = resolve_pairs(refs, "base", "ref", "asset_url")
    return cut_lineage(resolved.where(P.asset_extension("asset_url")).select("site", "asset_url").distinct())


def asset_inventory(refs: DataFrame) -> DataFrame:
    """(site, asset_url, file_name, ext, name_winner): the smallest URL claims
    a file name within a site (an aggregate, safe for a hot name)."""
    inv = refs.select("site", "asset_url", U.asset_filename("asset_url").alias("file_name"),
                      U.url_extension("asset_url").alias("ext"))
    win = inv.groupBy("site", "file_name").agg(F.min("asset_url").alias("winner"))
    return inv.join(win, ["site", "file_name"]).select(
        "site", "asset_url", "file_name", "ext", (F.col("asset_url") == F.col("winner")).alias("name_winner"))


def rewrite_asset_links(content: Column, assets_dir: str = "assets") -> Column:
    """``![alt](.../name.png?x)`` -> ``![alt](<assets_dir>/name.png)``."""
    return F.regexp_replace(content, REWRITE_RE, "![$1](" + assets_dir + "/$2)")
