"""``urljoin`` as an Arrow-batched UDF (Spark has no relative-URL resolver).

Apply it to the distinct (base, ref) pairs only, then join back: references
repeat heavily across pages of a site.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    def one(b, r):
        if r is None:
            return None
        try:
            return urljoin(b or "", r)
        except ValueError:
            return None
    return pd.Series([one(b, r) for b, r in zip(base, ref)], dtype=object)


DOT_SEGMENT = r"(^|/)\.\.?(/|$)"


def _simple_path(path: Column) -> Column:
    return ~path.rlike(DOT_SEGMENT)


def resolve_fast(base: Column, ref: Column) -> Column:
    """``urljoin`` for the common reference forms, as Catalyst expressions;
    NULL where the reference needs the full algorithm (dot segments, query- or
    fragment-only, scheme without ``//``, unusual bases)."""
    from .urls import url_netloc, url_path, url_scheme

    root = F.concat(url_scheme(base), F.lit("://"), url_netloc(base))
    bpath = url_path(base)
    base_ok = base.rlike("^(?i)[a-z][a-z0-9+.-]*://[^/?#]*") & _simple_path(bpath)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    dirpart = F.when(bpath == "", F.lit("/")).otherwise(F.regexp_extract(bpath, r"^(.*/)", 1))
    return (
        F.when(ref.rlike("^(?i)[a-z][a-z0-9+.-]*://"), ref)
        .when(~base_ok | ~_simple_path(ref_path), F.lit(None))
        .when(ref.startswith("//"), F.concat(url_scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.rlike(r"^[^:/?#]+(/|$|\?|#)") | ref.rlike(r"^[^:/?#]+$"), F.concat(root, dirpart, ref))
    )


def resolve_pairs(df: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """Add ``out`` = urljoin(base, ref). Common forms are resolved by
    expressions; the rest goes through the Arrow UDF once per distinct pair."""
    fast = resolve_fast(F.col(base), F.col(ref))
    tagged = df.withColumn(out, fast)
    done = tagged.where(F.col(out).isNotNull())
    hard = tagged.where(F.col(out).isNull()).drop(out)
    pairs = hard.select(base, ref).distinct()
    pairs = pairs.select(base, ref, resolve_url(F.col(base), F.col(ref)).alias(out))
    return done.unionByName(hard.join(pairs, [base, ref], "left").select(*df.columns, out))
