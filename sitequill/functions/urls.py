"""URL projections (all Catalyst expressions, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, py_title

# RFC 3986 appendix B. Groups: 2 scheme, 4 authority, 5 path, 7 query, 9 fragment.
URL_RE = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def url_scheme(col) -> Column:
    return F.regexp_extract(_c(col), URL_RE, 2)


def url_netloc(col) -> Column:
    return F.regexp_extract(_c(col), URL_RE, 4)


def url_path(col) -> Column:
    return F.regexp_extract(_c(col), URL_RE, 5)


def url_query(col) -> Column:
    return F.regexp_extract(_c(col), URL_RE, 7)


def url_fragment(col) -> Column:
    return F.regexp_extract(_c(col), URL_RE, 9)


def site_of(col) -> Column:
    """Default site key: the lower-cased host."""
    return F.lower(url_netloc(col))


def site_root(col) -> Column:
    """``scheme://netloc`` of a URL: the base URL of its site."""
    return F.concat(url_scheme(col), F.lit("://"), url_netloc(col))


def _cut(col, *seps: str) -> Column:
    c = _c(col)
    for s in seps:
        c = F.substring_index(c, s, 1)
    return c


def lookup_key(col) -> Column:
    """Cut at the first ``#`` and at the first ``?``."""
    return _cut(col, "#", "?")


def strip_fragment(col) -> Column:
    return _cut(col, "#")


def clean_link_url(col) -> Column:
    """Cut ``#`` and ``?``, then drop one trailing ``/``."""
    return F.regexp_replace(lookup_key(col), "/$", "")


def tree_key(col) -> Column:
    """Cut ``#``, strip every trailing ``/``."""
    return F.regexp_replace(_cut(col, "#"), "/+$", "")


def _after_scheme(c: Column) -> Column:
    pos = F.instr(c, "://")
    return F.when(pos > 0, c.substr(pos + 3, F.lit(1 << 30))).otherwise(c)


def canonical_url(col) -> Column:
    """Key used to merge discovery sources.

    Cut ``#`` then ``?``; strip trailing ``/``; drop everything through the
    first ``://``; drop one leading ``www.``; lower-case.
    """
    c = _after_scheme(F.regexp_replace(lookup_key(col), "/+$", ""))
    c = F.when(c.startswith("www."), c.substr(F.lit(5), F.lit(1 << 30))).otherwise(c)
    return F.lower(c)


def normalize_url(col) -> Column:
    """Variant key: removes ``https://``, ``http://`` and ``www.`` anywhere."""
    c = F.regexp_replace(lookup_key(col), "/+$", "")
    for s in ("https://", "http://", "www."):
        c = F.replace(c, F.lit(s), F.lit(""))
    return F.lower(c)


def _last_segment(path: Column) -> Column:
    return F.substring_index(F.trim(path, F.lit("/")), "/", -1)


def title_from_url(col, keep_underscore: bool = False) -> Column:
    """Last path segment, dashes (and underscores) to spaces, Python title case;
    ``Introduction`` for the site root."""
    seg = _last_segment(url_path(col))
    words = F.translate(seg, "-", " ") if keep_underscore else F.translate(seg, "-_", "  ")
    return F.when(F.length(F.trim(url_path(col), F.lit("/"))) == 0, F.lit("Introduction")).otherwise(py_title(words))


def title_from_stem(path_col) -> Column:
    """File stem of a path, dashes/underscores to spaces, title case."""
    name = F.regexp_extract(_c(path_col), r"([^/]*)$", 1)
    # pathlib: the suffix starts at the last dot unless that dot is first or last.
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    return py_title(F.translate(stem, "-_", "  "))


def path_segments(col) -> Column:
    return F.split(F.trim(url_path(col), F.lit("/")), "/")


def depth_from_path(col, base_depth: int | Column = 0) -> Column:
    """``max(0, #segments(path.strip('/')) - base_depth)``; an empty path has 1 segment."""
    return F.greatest(F.lit(0), F.size(path_segments(col)) - base_depth)


def base_depth_of(base_col) -> Column:
    p = url_path(base_col)
    return F.when((p == "") | (p == "/"), F.lit(0)).otherwise(F.size(F.split(F.trim(p, F.lit("/")), "/")))


def estimate_depth(col, base_col) -> Column:
    """0 for the base path itself; else segments after a raw string-prefix cut."""
    up = F.trim(url_path(col), F.lit("/"))
    bp = F.trim(url_path(base_col), F.lit("/"))
    rest = F.when(up.startswith(bp), F.trim(up.substr(F.length(bp) + 1, F.lit(1 << 30)), F.lit("/"))).otherwise(up)
    return F.when((up == "") | (up == bp), F.lit(0)).otherwise(F.size(F.split(rest, "/")))


def md_url(col) -> Column:
    """Sitemap strategy: trailing slashes stripped, ``.md`` appended."""
    return F.concat(F.regexp_replace(_c(col), "/+$", ""), F.lit(".md"))


def md_candidates(col) -> Column:
    """Probe candidates in rank order: ``u.md`` then ``u/README.md``
    (the second only when ``u`` does not end in ``.md``)."""
    u = lookup_key(col)
    first = F.struct(F.lit(1).alias("cand_rank"), F.concat(u, F.lit(".md")).alias("cand_url"))
    second = F.struct(F.lit(2).alias("cand_rank"), F.concat(u, F.lit("/README.md")).alias("cand_url"))
    return F.when(u.endswith(".md"), F.array(first)).otherwise(F.array(first, second))


def asset_filename(col) -> Column:
    """Last non-empty path segment (``pathlib`` drops a trailing slash)."""
    return F.regexp_extract(url_path(col), r"([^/]*)/*$", 1)


def url_extension(col) -> Column:
    return F.lower(F.regexp_extract(url_path(col), r"(\.[^./]*)$", 1))
