"""Document quality rules as one Spark projection, without user functions.

The thresholds stand in a table: a ratio of two measures, its bounds, and the
number of words from which it is judged. The table is compiled into column
expressions beside the measures themselves, so a document is read once and
nothing is shuffled. Repeated five-word windows are found by sorting a
document's own window hashes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text

WHITE_SPACE = r"[\x20\x09-\x0D]+"
WHITE_SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on with as at by from this be are was "
    "der die und das ist den von zu mit auf für im ein eine nicht "
    "le la les de et des du un une en est que pour dans il "
    "el los las y del se por con una es no su"
).split()
#: Punctuation stripped from a word's end before it is looked up.
WORD_END = ".,;:!?"


class Rule(NamedTuple):
    """Documents of ``from_words`` words or more pass if
    least <= numerator / denominator <= most."""

    name: str
    numerator: str
    denominator: str
    least: float
    most: float
    from_words: int


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0, 1),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1, 1),
    Rule("exclamations_per_word", "n_exclamations", "n_words", 0.0, 0.5, 1),
    Rule("stop_words", "n_stop_words", "n_words", 0.03, 1.0, 50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5, 20),
    Rule("lines_per_word", "n_lines", "n_words", 0.0, 0.5, 20),
)
#: Base rule: fewer words than this, or a larger percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_exclamations", "n_lines")


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """Words in five-word windows found twice or more in the document."""
    n = F.size(words) - (WINDOW - 1)
    hashed = F.sort_array(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return F.when(n < 2, F.lit(0)).otherwise(_with(_with(hashed, starts), covered))


def measures(text: Column) -> Column:
    """Struct of all measures of a text (null: no words)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    def of_words(w: Column) -> Column:
        stop = F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(WORD_END))).isin(STOP_WORDS))
        return F.struct(F.size(w).alias("n"), _repeated_words(w).alias("repeated"), F.size(stop).alias("stop"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))

    w, x = _with(words, of_words), _with(lines, of_lines)
    return F.struct(
        w.alias("w"), x.alias("x"), (F.length(text) - without(WHITE_SPACE_CHARS)).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"), without("!").alias("n_exclamations"))


def _fails(rule: Rule) -> Column:
    ratio = F.col(rule.numerator) / F.when(F.col(rule.denominator) > 0, F.col(rule.denominator))
    return (F.col("n_words") >= rule.from_words) & F.coalesce((ratio < rule.least) | (ratio > rule.most), F.lit(False))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measures, base_failed, kept, failed) of every row; ``failed``
    names the table's rules that a document breaks.

    Null text: no words, so the base rule fails. Repeated rows and null ids
    are judged like any other row; an empty table gives an empty result;
    other columns are not read.
    """
    m = id_text(docs, id_col, text_col).select("doc_id", measures(F.col("text")).alias("m"))
    values = {
        "n_words": F.col("m.w.n"), "word_chars": F.col("m.word_chars"), "n_symbols": F.col("m.n_symbols"),
        "n_dup_lines": F.col("m.x.n") - F.col("m.x.distinct"), "n_repeat_words": F.col("m.w.repeated"),
        "n_stop_words": F.col("m.w.stop"), "n_exclamations": F.col("m.n_exclamations"), "n_lines": F.col("m.x.n"),
    }
    flat = m.select("doc_id", *[values[k].cast("long").alias(k) for k in _MEASURES])
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return (flat.withColumn("base_failed", base).withColumn("failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_fails(rule: Rule) -> str:
    ratio = f"(CAST({rule.numerator} AS DOUBLE) / nullif({rule.denominator}, 0))"
    return f"(n_words >= {rule.from_words} AND coalesce({ratio} < {rule.least} OR {ratio} > {rule.most}, false))"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, list_filter(string_split_regex(t, '{WHITE_SPACE}'), lambda x: x <> '') AS ws,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
     s AS (SELECT doc_id, unnest(range(len(ws) - 4)) AS p, ws FROM w WHERE len(ws) >= 5),
     g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[p + 1 : p + 5], ' ')) AS n FROM s),
     r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM g WHERE n > 1) GROUP BY doc_id),
     m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
                  CAST(length(t) - length(translate(t, '!', '')) AS BIGINT) AS n_exclamations,
                  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                  CAST(len(list_filter(ws, lambda x: lower(rtrim(x, '{WORD_END}')) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS BIGINT) AS n_stop_words
           FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
     b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(map(_sql_fails, RULES))}) AS kept
FROM b
"""
