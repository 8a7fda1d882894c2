"""Library of written documents: file listing, metadata, heading audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import cut_lineage
from .consolidate import PREVIEW_CHARS, heads_path
from .fusion import SPLITLINES_RE
from .scan import exclusive_running_sum

SOURCE_RE = r"\*\*Source:\*\* (https?://\S+)"


def record_values(blocks: DataFrame) -> DataFrame:
    """Text records of each document as the sink writes them (one record per
    block, each followed by a newline): (site, part, k1, k2, value)."""
    body = F.expr("substring(block, 1, length(block) - 1)")
    value = F.when(F.col("part") == 0, body).otherwise(F.concat(F.lit("\n"), body))
    return blocks.select("site", "part", "k1", "k2", value.alias("value"))


def heading_audit(blocks: DataFrame) -> DataFrame:
    """Every document line whose stripped form starts with ``#``: (site,
    line_no 1-based, text). Line numbers come from an ordered running sum of
    per-block line counts (``scan.exclusive_running_sum``)."""
    lines = F.split("value", "\n", -1)
    stripped = F.transform(lines, lambda l, i: F.struct(i.alias("i"), TX.py_strip(l).alias("text")))
    # Each block is reduced to its line count and its headings before any shuffle.
    rec = record_values(blocks).select(
        "site", "part", "k1", "k2", F.size(lines).alias("n_lines"), F.filter(stripped, lambda h: h["text"].startswith("#")).alias("heads"))
    rec = exclusive_running_sum(rec, "site", ["part", "k1", "k2"], "n_lines", "before")
    return rec.select("site", "before", F.inline("heads")).select("site", (F.col("before") + F.col("i") + 1).alias("line_no"), "text")


#: Characters of the keys of the inverted index.
KEY_CHARS = 4


def _keys(text, length: int) -> F.Column:
    """Distinct runs of ``length`` characters of a text."""
    chars = F.split(text, "")
    n = F.length(text) - length
    run = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(*[F.get(chars, i + j) for j in range(length)]))
    return F.when(n >= 0, F.array_distinct(run)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(text, target): every distinct text (column ``text``) that contains a
    distinct target (column ``target``) as a substring.

    An inverted index by runs of KEY_CHARS characters (for shorter targets of
    as many as they have): a text holds a target only if it holds each of its
    runs, so one run of each target is enough as a key. It is the one that
    fewest texts hold, which also keeps common runs out of the join; a target
    with a run that no text holds is done with. What meets is compared. Nulls
    match nothing; an empty target is in every text."""
    distinct = texts.select("text").where(F.col("text").isNotNull()).distinct()
    wanted = targets.select("target").where(F.col("target").isNotNull()).distinct()
    sized = wanted.withColumn("k", F.least(F.length("target"), F.lit(KEY_CHARS)))
    by_size = [r["k"] for r in sized.select("k").distinct().collect()]  # KEY_CHARS + 1 values at most
    found = []
    for k in sorted(by_size):
        own = sized.where(F.col("k") == k)
        if k == 0:
            found.append(distinct.select("text", F.lit("").alias("target")))
            continue
        index = cut_lineage(distinct.select("text", F.explode(_keys(F.col("text"), k)).alias("key")))
        counts = index.groupBy("key").agg(F.count("*").alias("n"))
        runs = own.select("target", F.explode(_keys(F.col("target"), k)).alias("key")).join(counts, "key", "left")
        rarest = runs.groupBy("target").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
        found.append(index.join(rarest, "key").where(F.instr(F.col("text"), F.col("target")) > 0).select("text", "target"))
    out = texts.sparkSession.createDataFrame([], "text string, target string")
    for part in found:
        out = out.unionByName(part)
    return out


def target_heading_audit(headings: DataFrame, targets: list[str] | DataFrame) -> DataFrame:
    """Heading lines containing any target title: (site, line_no, text, target).

    The targets are a list or a table with a column ``target``; each counts
    once. Any number of them is matched by ``containing``."""
    if not isinstance(targets, DataFrame):
        targets = headings.sparkSession.createDataFrame([(x,) for x in targets], "target string")
    headings = cut_lineage(headings.select("site", "line_no", "text"))
    return headings.join(containing(headings, targets), "text").select("site", "line_no", "text", "target")


def library_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """File listing with sizes and times, contents not read (binaryFile with
    the ``content`` column pruned): (path, dir, size, modified)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return files.select(F.col("path"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
                        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def library_metadata(spark: SparkSession, path: str, glob: str = "*.md", by_dir: bool = False) -> DataFrame:
    """One entry per document: (name, title, source, size, modified, created),
    newest first. Title: first ``# `` line of the first 500 characters, else
    the name; source: the ``**Source:**`` URL there, else ``Unknown``.

    ``by_dir``: a document is a directory of ordered part files as
    ``consolidate.sink_documents`` writes them; their heads stand in the small
    table beside them, so no part file is opened, only listed. Otherwise a
    document is a file, read in one pass with its size and time.
    """
    if by_dir:
        files = library_files(spark, path, glob)
        docs = files.groupBy(F.regexp_extract("dir", r"([^/]*)$", 1).alias("name")).agg(
            F.sum("size").alias("size"), F.max("modified").alias("modified"), F.min("modified").alias("created"))
        heads = spark.read.parquet(heads_path(path))
        j = docs.join(heads, F.url_decode(F.replace(docs["name"], F.lit("+"), F.lit("%2B"))) == F.concat(F.lit("site="), heads["site"]), "left")
    else:
        read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
        m = F.col("_metadata")
        j = read.select(m["file_name"].alias("name"), F.left("value", F.lit(PREVIEW_CHARS)).alias("head"), m["file_size"].alias("size"),
                        m["file_modification_time"].alias("modified"), m["file_modification_time"].alias("created"))
    lines = F.split(F.coalesce("head", F.lit("")), SPLITLINES_RE, -1)
    first_h1 = F.try_element_at(F.filter(lines, lambda l: l.startswith("# ")), F.lit(1))
    src = F.regexp_extract(F.coalesce("head", F.lit("")), SOURCE_RE, 1)
    return j.select(
        "name",
        F.coalesce(TX.py_strip(F.substring(first_h1, 3, 1 << 30)), F.col("name")).alias("title"),
        F.when(src != "", src).otherwise(F.lit("Unknown")).alias("source"),
        "size", "modified", "created",
    ).orderBy(F.col("modified").desc(), "name")
