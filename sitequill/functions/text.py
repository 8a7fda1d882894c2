"""String rules of the reference expressed as Catalyst expressions.

Python and the JVM disagree on ``str.strip``, ``str.title`` and ``\\w``; each
function here pins the Python behaviour with an explicit character class so the
result is the same in Spark and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, in code point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A "cased" letter in Python's sense (Lu, Ll, Lt); str.title() flips case at
# every boundary between cased and uncased characters.
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
TITLE_RUNS = rf"([{CASED}]+|[^{CASED}]+)"

# Word characters for the fuzzy title match: letters, digits, underscore, space.
FOLD_DROP = r"[^\p{L}\p{N}_" + PY_WHITESPACE + "]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: all Unicode whitespace at both ends."""
    return F.trim(_c(col), F.lit(PY_WHITESPACE))


def py_rstrip(col) -> Column:
    return F.rtrim(_c(col), F.lit(PY_WHITESPACE))


def py_title(col) -> Column:
    """Python ``str.title()``: upper after an uncased char, lower elsewhere."""
    runs = F.regexp_extract_all(_c(col), F.lit(TITLE_RUNS), 1)
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))),
        "",
    )


def fold_for_match(col) -> Column:
    """lower, then drop every character that is neither word nor whitespace."""
    return F.regexp_replace(F.lower(_c(col)), FOLD_DROP, "")


def squeeze_newlines(col, keep: int = 3) -> Column:
    """Runs of more than ``keep`` newlines become exactly ``keep``."""
    return F.regexp_replace(_c(col), "\n{%d,}" % (keep + 1), "\n" * keep)


def clean_title(col) -> Column:
    """Text before the first ``|``, stripped."""
    return py_strip(F.substring_index(_c(col), "|", 1))


def strip_title_suffix(col) -> Column:
    """Cut at `` | ``, else at `` - ``, then strip."""
    c = _c(col)
    cut = (
        F.when(F.instr(c, " | ") > 0, F.substring_index(c, " | ", 1))
        .when(F.instr(c, " - ") > 0, F.substring_index(c, " - ", 1))
        .otherwise(c)
    )
    return py_strip(cut)


def content_md5(col) -> Column:
    """md5 hex of the stripped UTF-8 content."""
    return F.md5(py_strip(col))


def is_blank(col) -> Column:
    return F.coalesce(F.length(py_strip(col)) == 0, F.lit(True))
