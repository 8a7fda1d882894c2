"""Library of documents as an append-only table with a manifest.

Each run appends the text of its documents and one manifest row per document
and part: bytes, records and time, taken from the rows as they are written.
Readers take a snapshot of the manifest: the last version of each document, and
its times. No folder is listed and no document is opened for that, however
many files the text is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..streaming.append_table import AppendTable
from .consolidate import PREVIEW_CHARS
from .fusion import SPLITLINES_RE
from .library import SOURCE_RE, record_values
from .scan import dense_number

TEXT_SCHEMA = "document string, part int, k1 decimal(38,0), k2 string, value string, piece int"
MANIFEST_SCHEMA = "document string, piece int, records long, bytes long, head string, written timestamp"


class DocumentTable:
    """Documents at ``path`` in the shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        root = path.rstrip("/")
        self.text = AppendTable(spark, f"{root}/text", TEXT_SCHEMA)
        self.entries = AppendTable(spark, f"{root}/documents", MANIFEST_SCHEMA)

    def add(self, blocks: DataFrame, run: int, written: str | None = None) -> bool:
        """Append the documents of a run (blocks as ``consolidate`` makes them)
        once; False if the run is there already. ``written``: its time, now by
        default. A document with a third of all text is many pieces, one per
        range partition it spans, in reading order."""
        if self.entries.committed(run):
            return False
        keys = ["site", "part", "k1", "k2"]
        ranged = record_values(blocks).repartitionByRange(*keys).sortWithinPartitions(*keys)
        rows = ranged.select(F.col("site").alias("document"), "part", F.col("k1").cast("decimal(38,0)").alias("k1"), "k2", "value", F.spark_partition_id().alias("piece"))
        self.text.append(rows, run)  # a run that died after this finds it committed and goes on
        at = F.lit(written).cast("timestamp") if written else F.current_timestamp()
        made = self.text.snapshot().where(F.col("batch_id") == run).groupBy("document", "piece").agg(
            F.count("*").alias("records"), F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"),
            F.max(F.when(F.col("part") == 0, F.left("value", F.lit(PREVIEW_CHARS)))).alias("head"))
        return self.entries.append(made.withColumn("written", at), run)

    def snapshot(self, as_of_run: int | None = None) -> DataFrame:
        """Last version of every document, up to a run if one is given: (document,
        run, size, pieces, head, modified, created)."""
        rows = self.entries.snapshot()
        rows = rows if as_of_run is None else rows.where(F.col("batch_id") <= as_of_run)
        runs = rows.groupBy("document", "batch_id").agg(
            F.sum("bytes").alias("size"), F.count("*").alias("pieces"), F.max("head").alias("head"), F.max("written").alias("written"))
        last = F.max(F.struct("batch_id", "size", "pieces", "head", "written")).alias("v")
        return runs.groupBy("document").agg(last, F.min("written").alias("created")).select(
            "document", F.col("v.batch_id").alias("run"), "v.size", "v.pieces", "v.head", F.col("v.written").alias("modified"), "created")

    def metadata(self, as_of_run: int | None = None) -> DataFrame:
        """(document, title, source, size, modified, created, newest): the last
        versions, numbered from the newest on (ties by name). Title and source
        come from the head, as ``library.library_metadata`` says."""
        docs = self.snapshot(as_of_run)
        lines = F.split(F.coalesce("head", F.lit("")), SPLITLINES_RE, -1)
        h1 = F.try_element_at(F.filter(lines, lambda l: l.startswith("# ")), F.lit(1))
        source = F.regexp_extract(F.coalesce("head", F.lit("")), SOURCE_RE, 1)
        named = docs.select(
            "document", F.coalesce(TX.py_strip(F.substring(h1, 3, 1 << 30)), F.col("document")).alias("title"),
            F.when(source != "", source).otherwise(F.lit("Unknown")).alias("source"), "size", "modified", "created")
        return dense_number(named, [F.desc("modified"), "document"], "newest")

    def read(self, document: str, as_of_run: int | None = None) -> DataFrame:
        """Records of a document's last version in reading order: (piece, part,
        k1, k2, value). Only that run's rows of that document are read."""
        version = self.snapshot(as_of_run).where(F.col("document") == document).first()
        run = -1 if version is None else version["run"]
        rows = self.text.snapshot().where((F.col("document") == document) & (F.col("batch_id") == run))
        return rows.select("piece", "part", "k1", "k2", "value").orderBy("part", "k1", "k2")
