"""Append-only table with a manifest: exactly-once sink of micro-batches,
snapshot reads and compaction.

Every append writes a folder of its own and then one manifest row that names
it; readers see the folders of the manifest and nothing else. An append that
died before its row was committed is overwritten when it is repeated; one that
was committed is skipped, so a replayed micro-batch adds no row. Compaction
rewrites what the manifest holds as one folder and says so in a row of its own;
the folders it replaces are no longer read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

MANIFEST_SCHEMA = "batch_id long, kind string, folder string, rows long, committed timestamp"


class AppendTable:
    """A table at ``path`` in the shared folder; ``schema`` is that of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def manifest(self) -> DataFrame:
        """(batch_id, kind, folder, rows, committed) of all appends and compactions."""
        at = f"{self.path}/manifest"
        if not path_exists(self.spark, at):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").parquet(at)

    def _commit(self, batch_id: int, kind: str, folder: str, rows: int) -> None:
        row = self.spark.createDataFrame([(batch_id, kind, folder, rows)], "batch_id long, kind string, folder string, rows long")
        row.withColumn("committed", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{kind}-{batch_id:010d}")

    def committed(self, batch_id: int) -> bool:
        return path_exists(self.spark, f"{self.path}/manifest/batch-{batch_id:010d}/_SUCCESS")

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Add a micro-batch once; False if it was there already. Its rows get
        the column ``batch_id``."""
        if self.committed(batch_id):
            return False
        folder = f"data/batch-{batch_id:010d}"
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self._commit(batch_id, "batch", folder, self._read([folder]).count())
        return True

    def _read(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        schema = f"{self.schema}, batch_id long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def live_folders(self) -> list[str]:
        """Folders of the snapshot: the last compaction and the batches after
        it. The list has one entry an append since the last compaction."""
        entries = self.manifest().collect()
        upto = max((e["batch_id"] for e in entries if e["kind"] == "compact"), default=-1)
        live = [e for e in entries if e["batch_id"] == upto and e["kind"] == "compact" or e["batch_id"] > upto and e["kind"] == "batch"]
        return [e["folder"] for e in sorted(live, key=lambda e: e["batch_id"])]

    def snapshot(self) -> DataFrame:
        """The rows of all committed appends, with their ``batch_id``."""
        return self._read(self.live_folders())

    def compact(self, reduce: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rewrite the snapshot as one folder, sized by AQE; ``reduce`` may drop
        rows that later ones replace."""
        entries = [e["batch_id"] for e in self.manifest().collect()]
        if not entries:
            return
        folder = f"data/compact-{max(entries):010d}"
        rows = self.snapshot()
        kept = reduce(rows) if reduce else rows
        kept.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self._commit(max(entries), "compact", folder, self._read([folder]).count())

    def sink(self, compact_every: int = 0, reduce: Callable[[DataFrame], DataFrame] | None = None, through: Callable[[DataFrame], DataFrame] | None = None):
        """Function for ``foreachBatch``: appends each micro-batch (after
        ``through``), and compacts after every ``compact_every``-th."""

        def write(batch: DataFrame, batch_id: int) -> None:
            added = self.append(through(batch) if through else batch, batch_id)
            if added and compact_every and (batch_id + 1) % compact_every == 0:
                self.compact(reduce)

        return write
