"""DuckDB SQL twins of the Catalyst column functions, for the oracle queries.

Each builder takes a SQL expression string and returns a SQL expression string
with the same semantics as the Spark function of the same name.
"""

from __future__ import annotations

from ..functions.text import FOLD_DROP, PY_WHITESPACE, TITLE_RUNS
from ..functions.urls import URL_RE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS = q(PY_WHITESPACE)
_BIG = "1073741824"


def py_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def py_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, {q(TITLE_RUNS)}, 1), "
            f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')")


def fold_for_match(x: str) -> str:
    return f"regexp_replace(lower({x}), {q(FOLD_DROP)}, '', 'g')"


def squeeze_newlines(x: str, keep: int = 3) -> str:
    return f"regexp_replace({x}, {q(chr(10) + '{%d,}' % (keep + 1))}, {q(chr(10) * keep)}, 'g')"


def clean_title(x: str) -> str:
    return py_strip(f"split_part({x}, '|', 1)")


def strip_title_suffix(x: str) -> str:
    return py_strip(f"CASE WHEN strpos({x}, ' | ') > 0 THEN split_part({x}, ' | ', 1) "
                    f"WHEN strpos({x}, ' - ') > 0 THEN split_part({x}, ' - ', 1) ELSE {x} END")


def content_md5(x: str) -> str:
    return f"md5({py_strip(x)})"


def url_part(x: str, group: int) -> str:
    return f"regexp_extract({x}, {q(URL_RE)}, {group})"


def url_scheme(x):
    return url_part(x, 2)


def url_netloc(x):
    return url_part(x, 4)


def url_path(x):
    return url_part(x, 5)


def url_query(x):
    return url_part(x, 7)


def url_fragment(x):
    return url_part(x, 9)


def site_of(x):
    return f"lower({url_netloc(x)})"


def site_root(x):
    return f"({url_scheme(x)} || '://' || {url_netloc(x)})"


def lookup_key(x):
    return f"split_part(split_part({x}, '#', 1), '?', 1)"


def strip_fragment(x):
    return f"split_part({x}, '#', 1)"


def clean_link_url(x):
    return f"regexp_replace({lookup_key(x)}, '/$', '')"


def tree_key(x):
    return f"rtrim(split_part({x}, '#', 1), '/')"


def canonical_url(x):
    c1 = f"rtrim({lookup_key(x)}, '/')"
    c2 = f"(CASE WHEN strpos({c1}, '://') > 0 THEN substr({c1}, strpos({c1}, '://') + 3) ELSE {c1} END)"
    return f"lower(CASE WHEN starts_with({c2}, 'www.') THEN substr({c2}, 5) ELSE {c2} END)"


def normalize_url(x):
    c = f"rtrim({lookup_key(x)}, '/')"
    for s in ("https://", "http://", "www."):
        c = f"replace({c}, {q(s)}, '')"
    return f"lower({c})"


def title_from_url(x, keep_underscore: bool = False):
    p = f"trim({url_path(x)}, '/')"
    seg = f"split_part({p}, '/', -1)"
    words = f"replace({seg}, '-', ' ')" if keep_underscore else f"translate({seg}, '-_', '  ')"
    return f"(CASE WHEN length({p}) = 0 THEN 'Introduction' ELSE {py_title(words)} END)"


def title_from_stem(x):
    name = f"regexp_extract({x}, '([^/]*)$', 1)"
    stem = (f"(CASE WHEN regexp_matches({name}, '^.+\\.[^.]+$') "
            f"THEN regexp_extract({name}, '^(.+)\\.[^.]+$', 1) ELSE {name} END)")
    return py_title(f"translate({stem}, '-_', '  ')")


def path_segments(x):
    return f"string_split(trim({url_path(x)}, '/'), '/')"


def depth_from_path(x, base_depth: str = "0"):
    return f"CAST(greatest(0, len({path_segments(x)}) - {base_depth}) AS INTEGER)"


def estimate_depth(x, base):
    up = f"trim({url_path(x)}, '/')"
    bp = f"trim({url_path(base)}, '/')"
    rest = f"(CASE WHEN starts_with({up}, {bp}) THEN trim(substr({up}, length({bp}) + 1), '/') ELSE {up} END)"
    return f"CAST(CASE WHEN {up} = '' OR {up} = {bp} THEN 0 ELSE len(string_split({rest}, '/')) END AS INTEGER)"


def md_url(x):
    return f"(rtrim({x}, '/') || '.md')"


def asset_filename(x):
    return f"regexp_extract({url_path(x)}, '([^/]*)/*$', 1)"


def url_extension(x):
    return f"lower(regexp_extract({url_path(x)}, '(\\.[^./]*)$', 1))"


# ---------------------------------------------------------------------------
# Fixed values as the oracles state them, written out so that an oracle does
# not share the constant that it checks.
# ---------------------------------------------------------------------------

SKIP_RE = (r"/search|/login|/logout|/edit|/admin|/api/|/assets/|/static/|\.(css|js|json|xml|rss|txt)$|\.(jpg|png|gif|svg|ico|pdf)$"
           r"|mailto:|tel:|javascript:")
ASSET_RE = r"\.(png|jpg|jpeg|gif|svg|webp|ico|pdf|zip|tar|gz)$"
BLOCKED = ("/login", "/signup", "/signin", "/register", "twitter.com", "discord.gg")
PLACEHOLDER_TITLES = ("Untitled", "Native Page", "Introduction")
IMAGE_LINK_RE = r"!\[(.*?)\]\((?:[^)]*/)?([^/?#)]+\.(?i:png|jpg|jpeg|gif|svg|webp|ico|pdf|zip|tar|gz))(?:[?#][^)]*)?\)"
SOURCE_LINE_RE = r"\*\*Source:\*\* (https?://\S+)"
LINE_END_RE = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
HEADING_RE = ("(?s)^(#+)[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000]+(.*)")
