"""Filters of the reference as boolean Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, py_strip
from .urls import url_netloc, url_path

# Page URLs the link crawler skips (matched on the lower-cased URL).
SKIP_PATTERNS = [
    r"/search", r"/login", r"/logout", r"/edit",
    r"/admin", r"/api/", r"/assets/", r"/static/",
    r"\.(css|js|json|xml|rss|txt)$",
    r"\.(jpg|png|gif|svg|ico|pdf)$",
    r"mailto:", r"tel:", r"javascript:",
]
SKIP_RE = "|".join(f"(?:{p})" for p in SKIP_PATTERNS)

# Path fragments that make a scanned link unwanted.
LINK_BLOCKLIST = ["/login", "/signup", "/signin", "/register", "twitter.com", "discord.gg"]

# File extensions counted as downloadable assets.
ASSET_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".pdf", ".zip", ".tar", ".gz"]
ASSET_RE = r"\.(" + "|".join(e[1:] for e in ASSET_EXTENSIONS) + r")$"


def exclude_terms(exclude: str | None) -> list[str]:
    """Comma-separated exclude option -> lower-cased non-blank terms."""
    return [t.strip().lower() for t in (exclude or "").split(",") if t.strip()]


def include_exclude(url, section: str | None = None, exclude: str | None = None,
                    case_sensitive: bool = False) -> Column:
    """Keep a URL if it contains ``section`` and none of the exclude terms."""
    u = _c(url)
    lu = F.lower(u)
    cond = F.lit(True)
    if section:
        cond = cond & (u.contains(section) if case_sensitive else lu.contains(section.lower()))
    for t in exclude_terms(exclude):
        cond = cond & ~lu.contains(t)
    return cond


def valid_page_url(url, base_netloc) -> Column:
    """Same host as the page it was found on and none of the skip patterns."""
    u = _c(url)
    return (
        u.isNotNull() & (u != "") & ~u.startswith("#")
        & (url_netloc(u) == _c(base_netloc))
        & ~F.lower(u).rlike(SKIP_RE)
    )


def link_blocked(url) -> Column:
    lp = F.lower(url_path(url))
    cond = F.lit(False)
    for t in LINK_BLOCKLIST:
        cond = cond | lp.contains(t)
    return cond


def looks_like_markdown(body) -> Column:
    return ~F.lower(py_strip(body)).startswith("<!doctype html")


def min_content(content, title) -> Column:
    c = _c(content)
    t = _c(title)
    return (c.isNotNull() & (c != "")) & (
        (F.length(py_strip(c)) > 50) | (t.isNotNull() & (t != ""))
    )


def asset_extension(url) -> Column:
    return F.lower(url_path(url)).rlike(ASSET_RE)


def skip_asset_url(u) -> Column:
    c = _c(u)
    return (c.isNull() | (c == "") | c.startswith("#") | c.startswith("data:") | c.startswith("javascript:"))
