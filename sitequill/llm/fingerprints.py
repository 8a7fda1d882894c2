"""Threshold-scaled document sketches, with DataFrame functions only.

A document's shingles (runs of five words) are hashed, and every hash below a
fixed fraction of the hash range is retained. The sketch of a union is the
union of the sketches, and because both sides keep the same part of the hash
range, the share of a sketch found in another estimates the containment of
the documents, however unequal their lengths. A document whose hashes all lie
above the threshold keeps its smallest one, so only documents without words
have an empty sketch.

The hash is the first 60 bits of MD5, as SQL engines agree on it; "below a
fraction of 1/2" is then "its first hexadecimal digit is below 8", a plain
string comparison. Only what is retained becomes a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import neighbor_value
from .common import id_text

SHINGLE_WORDS = 5
#: Hashes below this string are retained: one in two.
THRESHOLD = "8"
#: One in 16, enough where all documents are long.
THIN_THRESHOLD = "1"
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def sketch(text: Column, shingle: int = SHINGLE_WORDS, threshold: str = THRESHOLD) -> Column:
    """Sorted distinct retained hashes. Fewer words than a shingle: all words
    as one shingle; no words (null, empty or blank text): empty."""

    def retained(w: Column) -> Column:
        n = F.greatest(F.size(w) - (shingle - 1), F.least(F.size(w), F.lit(1)))
        hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, shingle), " ").cast("binary")), 1, 15))
        return F.when(n > 0, hashes).otherwise(F.array().cast("array<string>"))

    def kept(hashes: Column) -> Column:
        below = F.filter(hashes, lambda h: h < threshold)
        return F.when((F.size(below) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.sort_array(F.array_distinct(below)))

    def numbers(hashes: Column) -> Column:
        return F.transform(hashes, lambda h: F.conv(h, 16, 10).cast("bigint"))

    # One-element transforms name intermediate arrays, so that each is computed once.
    return F.transform(F.transform(F.transform(F.transform(F.array(text), words), retained), kept), numbers)[0]


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller document in the larger one: the
    share of the shorter sketch found in the other; 1 for two empty sketches,
    0 for an empty and a filled one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def merged(sketches: Column, threshold: str = THRESHOLD) -> Column:
    """Sketch of the union of documents from an array of their sketches, which
    all have this threshold: what lies below it, and, only where nothing does,
    the smallest hash of all."""
    limit = int(threshold.ljust(15, "0"), 16)
    every = F.flatten(sketches)
    below = F.filter(every, lambda x: x < limit)
    return F.when((F.size(below) == 0) & (F.size(every) > 0), F.array(F.array_min(every))).otherwise(F.sort_array(F.array_distinct(below)))


def digest(a: Column) -> Column:
    return F.md5(F.array_join(a.cast("array<string>"), ",").cast("binary"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, threshold: str = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch) of every row. Null text: empty sketch. Sketches compare
    and merge with those of the same threshold; texts of some hundred words and
    less need one no lower than the default."""
    return id_text(docs, id_col, text_col).select("doc_id", sketch(F.col("text"), shingle, threshold).alias("sketch"))


def edited_fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, threshold: str = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited text: the last
    floor(n_chars / 2) code points replaced by as many first ones (or all) of
    the next row by falling doc_id; the last row's next is the first.

    The order is found on thin rows, range-partitioned. Each row then meets
    the row before it and sends it its text; each text is shuffled twice and
    sketches, which are larger, never.

    Null texts are empty and null ids come last; rows that share an id are
    ordered by a hash of their text, and rows equal in both are one document
    with one result on each of its rows; a single document is its own next;
    an empty table gives an empty result; other columns are not read.

    Returns doc_id, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (MD5 of the sketch), near_edited, near_next
    (``likeness``), sketch_size and next_doc_id.
    """
    src = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    src = src.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.hash("doc_id", F.lit(7)).alias("k2"), "text", F.length("text").cast("long").alias("n_chars"))
    full = src.drop("n_chars")

    order = src.select("doc_id", "k1", "k2", "n_chars").distinct()
    me = F.struct("k1", "k2", "n_chars")
    least = order.agg(F.min(F.struct("doc_id", "k1", "k2", "n_chars"))).first()[0]
    if least is None:
        lowest = F.lit(None).cast("struct<k1:bigint,k2:int,n_chars:bigint>")
    else:
        lowest = F.struct(F.lit(least["k1"]).cast("long").alias("k1"), F.lit(least["k2"]).cast("int").alias("k2"), F.lit(least["n_chars"]).cast("long").alias("n_chars"))
    # Rising ids: the row that follows is the one whose edited text begins with this row's.
    chain = neighbor_value(order.select("doc_id", "k1", me.alias("me"), F.lit(0).alias("all")), "all", ["doc_id", "k1"], "me", "before", "next")
    chain = chain.select(F.col("me.k1").alias("c1"), F.col("me.k2").alias("c2"), F.coalesce("before", lowest).alias("before"))

    # Both uses of ``full`` read the same columns, so its exchange is made once.
    here = full.join(chain, (full["k1"] == chain["c1"]) & (full["k2"] == chain["c2"]))
    sent = here.groupBy(F.col("before.k1").alias("b1"), F.col("before.k2").alias("b2")).agg(
        F.first("text").alias("next_text"), F.first("doc_id").alias("next_doc_id"))
    met = full.join(sent, (full["k1"] == sent["b1"]) & (full["k2"] == sent["b2"])).withColumn("n_chars", F.length("text").cast("long"))
    edited = met.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.expr("left(next_text, cast(n_chars div 2 as int))")))
    both = edited.select("*", *[sketch(F.col(c), shingle, threshold).alias(s) for c, s in (("text", "sketch"), ("edited", "edited_sketch"), ("next_text", "next_sketch"))])
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("sketch")).alias("fingerprint"), digest(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.size("sketch").cast("long").alias("sketch_size"), "next_doc_id")


def _sql_sketch(text: str) -> str:
    """DuckDB expression of ``sketch``."""
    w = f"list_filter(string_split_regex({text}, '{WHITE_SPACE}'), lambda w: w <> '')"
    k = SHINGLE_WORDS
    hashes = (f"list_transform([{w}], lambda ws: CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(greatest(len(ws) - {k - 1}, 1)), "
              f"lambda i: left(md5(array_to_string(ws[i + 1 : i + {k}], ' ')), 15)) END)")
    kept = (f"list_transform({hashes}, lambda hs: CASE WHEN len(hs) > 0 AND len(list_filter(hs, lambda h: h < '{THRESHOLD}')) = 0 "
            f"THEN [list_min(hs)] ELSE list_sort(list_distinct(list_filter(hs, lambda h: h < '{THRESHOLD}'))) END)[1]")
    return f"list_transform({kept}, lambda h: CAST('0x' || h AS BIGINT))"


def _sql_likeness(a: str, b: str) -> str:
    return (f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) "
            f"WHEN len({a}) = len({b}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


EDITED_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents),
     e AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx,
                  coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_doc_id FROM d),
     f AS (SELECT *, left(t, n - n // 2) || left(nx, n // 2) AS ed FROM e),
     g AS (SELECT *, {_sql_sketch("t")} AS a, {_sql_sketch("ed")} AS b, {_sql_sketch("nx")} AS c FROM f)
SELECT doc_id, n AS n_chars, sha256(ed) AS edited_sha256, md5(array_to_string(a, ',')) AS fingerprint, md5(array_to_string(b, ',')) AS edited_fingerprint,
       {_sql_likeness("a", "b")} AS near_edited, {_sql_likeness("a", "c")} AS near_next, CAST(len(a) AS BIGINT) AS sketch_size, next_doc_id
FROM g
"""
