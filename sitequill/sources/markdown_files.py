"""Markdown files of a checked-out documentation repository as page records."""

from __future__ import annotations

import fnmatch
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import urls as U

TITLE_LINES = 10


def markdown_title(content) -> F.Column:
    """First of the first 10 lines that starts ``# `` (after stripping), minus the marker."""
    lines = F.transform(F.slice(F.split(content, "\n", -1), 1, TITLE_LINES), lambda l: TX.py_strip(l))
    first = F.try_element_at(F.filter(lines, lambda l: l.startswith("# ")), F.lit(1))
    return TX.py_strip(F.substring(first, 3, 1 << 30))


EMPTY = "title string, url string, content string, source string, path string, error string"


def scan_markdown_files(spark: SparkSession, repo_dir: str, section_path: str | None = None, glob: str = "*.md") -> DataFrame:
    """Every Markdown file under ``repo_dir`` (or its ``section_path``
    sub-directory), recursively, read as bytes: (title, url, content, source,
    path, error). ``error`` says why a file cannot be read as UTF-8 text; its
    title and content are null then, and the other files are not affected. The
    folder may be on any file system Spark reads; a missing one gives no rows,
    and neither does a file of no bytes."""
    root = repo_dir.rstrip("/")
    search = f"{root}/{section_path.strip('/')}" if section_path else root
    try:
        df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(search)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EMPTY)
    fp = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    bare = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root)
    inside = F.substring(fp, F.instr(fp, bare + "/") + len(bare) + 1, 1 << 30)
    return markdown_records(df.select(inside.alias("path"), fp.alias("url"), "content"))


def pack_checkout(files: DataFrame, out: str) -> None:
    """Write (path, content binary) of a check-out as a few large Parquet files,
    sized by AQE: a repository of very many small files is neither listed on
    the driver nor opened file by file."""
    files.select("path", "content").hint("rebalance").write.mode("overwrite").parquet(out)


def scan_packed_checkout(spark: SparkSession, packed: str, section_path: str | None = None, glob: str = "*.md") -> DataFrame:
    """``scan_markdown_files`` of a packed check-out; urls are the paths."""
    files = spark.read.schema("path string, content binary").parquet(packed)
    files = files.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(fnmatch.translate(glob)))
    if section_path:
        files = files.where(F.col("path").startswith(section_path.strip("/") + "/"))
    return markdown_records(files.select("path", F.col("path").alias("url"), "content"))


def markdown_records(files: DataFrame) -> DataFrame:
    """(path, url, content binary) rows as page records with ``error``."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    read = files.select("path", "url", text.alias("content"))
    return read.select(
        F.when(F.col("content").isNotNull(), F.coalesce(markdown_title(F.col("content")), U.title_from_stem("path"))).alias("title"), "url", "content",
        F.lit("github").alias("source"), "path", F.when(F.col("content").isNull(), F.lit("not UTF-8")).alias("error"))


def scan_markdown_corpus(spark: SparkSession, repo_dir: str, section_path: str | None = None, glob: str = "*.md") -> DataFrame:
    """The readable files of ``scan_markdown_files`` as page records: (title,
    url, content, source, path)."""
    return scan_markdown_files(spark, repo_dir, section_path, glob).where("error IS NULL").drop("error")
