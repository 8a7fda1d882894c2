"""State of task runs by ``transformWithState``, from registration to exit.

A task is registered before it prints anything; until then its run is
``pending``, then ``running``, and ``completed`` or ``failed`` by its exit line.

Raw lines never reach Python state: the first query reads the lines and writes
one digest row per task and micro-batch (built-in aggregates with partial
aggregation, so a task with a third of all lines is one row per partition
before the shuffle). The second query merges digests and registrations into one
state per task. When a run has ended, a timer drops its state after a while;
until then late digests still count. Both queries write to append tables, so a
replayed micro-batch neither adds a digest nor merges one twice: digests carry
the number of their micro-batch, and a state remembers the last it took.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .append_table import AppendTable
from .line_source import stream_lines
from .progress import parse_event_lines

EXIT_RE = r"^EXIT (-?[0-9]+)$"
DIGEST_SCHEMA = ("task_id long, p struct<seq:long,current:long,total:long,status:string>, s struct<seq:long,stage:string>, "
                 "n_log_lines long, last_seq long, ended struct<seq:long,code:long>")
RUN_SCHEMA = "task_id long, run_status string, error string, current long, total long, status string, stage string, n_log_lines long"
_STATE = ("last_batch long, p_seq long, current long, total long, status string, s_seq long, stage string, "
          "n_log_lines long, seen boolean, e_seq long, code long")
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]
_RUN = Row(*[f.split()[0] for f in RUN_SCHEMA.split(", ")])
_INPUT = "task_id long, batch_id long, p_seq long, current long, total long, status string, s_seq long, stage string, n_log_lines long, e_seq long, code long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds that the state of an ended run is kept for late lines.
KEEP_ENDED_MS = 3_600_000


def digest_lines(lines: DataFrame) -> DataFrame:
    """One row per task of (task_id, seq, line): its latest progress, stage and
    exit, and the number of its log lines."""
    parsed = parse_event_lines(lines).withColumn("code", F.regexp_extract("text", EXIT_RE, 1).try_cast("long"))
    is_log = (F.col("kind") == "log") & F.col("code").isNull()
    return parsed.where("task_id IS NOT NULL").groupBy("task_id").agg(
        F.max(F.when(F.col("type") == "progress", F.struct("seq", "current", "total", "status"))).alias("p"),
        F.max(F.when(F.col("type") == "stage", F.struct("seq", "stage"))).alias("s"),
        F.count(F.when(is_log, 1)).alias("n_log_lines"), F.max("seq").alias("last_seq"),
        F.max(F.when(F.col("code").isNotNull(), F.struct("seq", "code"))).alias("ended"))


def _flat(digests: DataFrame) -> DataFrame:
    return digests.select(
        "task_id", "batch_id", F.col("p.seq").alias("p_seq"), F.col("p.current").alias("current"), F.col("p.total").alias("total"),
        F.col("p.status").alias("status"), F.col("s.seq").alias("s_seq"), F.col("s.stage").alias("stage"), "n_log_lines",
        F.col("ended.seq").alias("e_seq"), F.col("ended.code").alias("code"))


class TaskRun(StatefulProcessor):
    """Merges digests (and registrations: rows without a batch id)."""

    def __init__(self, keep_ended_ms: int) -> None:
        self.keep_ended_ms = keep_ended_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        # Each call of the state is a round trip to the JVM, so that they are few:
        # one read, one write, and timers only for a run that has ended.
        held = dict(zip(_FIELDS, self.run.get(), strict=True)) if self.run.exists() else dict.fromkeys(_FIELDS) | {"n_log_lines": 0, "seen": False}
        had_ended = held["code"] is not None
        # At most one digest a partition and micro-batch; the batches in order.
        found = list(rows)
        for r in sorted((r for r in found if r["batch_id"] is not None), key=lambda r: r["batch_id"]):
            if held["last_batch"] is not None and r["batch_id"] <= held["last_batch"]:
                continue
            held["last_batch"], held["seen"] = r["batch_id"], True
            held["n_log_lines"] += r["n_log_lines"]
            for mark, others in (("p_seq", ("current", "total", "status")), ("s_seq", ("stage",)), ("e_seq", ("code",))):
                if r[mark] is not None and (held[mark] is None or r[mark] > held[mark]):
                    held.update((c, r[c]) for c in (mark, *others))
        self.run.update(tuple(held[f] for f in _FIELDS))
        if had_ended:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held["code"] is not None:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), self.now(found)) + self.keep_ended_ms)
        yield self._row(key[0], held)

    def _row(self, task_id, held) -> Row:
        code = held["code"]
        run = "pending" if not held["seen"] else "running" if code is None else "completed" if code == 0 else "failed"
        keeps_stage = held["s_seq"] is not None and (held["p_seq"] is None or held["s_seq"] > held["p_seq"])
        return _RUN(task_id, run, f"Process exited with code {code}" if run == "failed" else None, held["current"], held["total"],
                    held["status"], held["stage"] if keeps_stage else None, held["n_log_lines"])

    @staticmethod
    def now(rows: list[Row]) -> int:
        """Time of the micro-batch, in milliseconds."""
        return max(int(r["at"].timestamp() * 1000) for r in rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _state_store(spark: SparkSession):
    """``transformWithState`` keeps its state in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def latest_runs(rows: DataFrame) -> DataFrame:
    """The row of each task from the last micro-batch that has one."""
    columns = [c for c in rows.columns if c != "task_id"]
    last = rows.groupBy("task_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("r"))
    return last.select("task_id", *[F.col("r." + c).alias(c) for c in columns])


class TaskRuns:
    """The two queries over the folders ``lines`` (run output, as
    ``line_source`` reads it) and ``registered`` (Parquet rows with a task_id).

    ``advance`` takes in what has come since the last call, also after a
    restart; ``runs`` are the tasks as of then."""

    def __init__(self, spark: SparkSession, root: str, keep_ended_ms: int = KEEP_ENDED_MS, compact_every: int = 10) -> None:
        self.spark, self.root, self.keep_ended_ms, self.compact_every = spark, root.rstrip("/"), keep_ended_ms, compact_every
        self.lines, self.registered = f"{self.root}/lines", f"{self.root}/registered"
        self.digests = AppendTable(spark, f"{self.root}/digests", DIGEST_SCHEMA)
        self.table = AppendTable(spark, f"{self.root}/runs", RUN_SCHEMA)

    def digest(self) -> None:
        """Take in the lines that have come since the last call."""
        query = (stream_lines(self.spark, self.lines).writeStream.foreachBatch(self.digests.sink(through=digest_lines))
                 .option("checkpointLocation", f"{self.root}/checkpoint-digests").trigger(availableNow=True).start())
        query.awaitTermination()

    def line_state(self) -> DataFrame:
        """Latest progress, stage and number of log lines per task, of the
        digests alone: (task_id, current, total, status, stage, n_log_lines)."""
        merged = self.digests.snapshot().groupBy("task_id").agg(F.max("p").alias("p"), F.max("s").alias("s"), F.sum("n_log_lines").alias("n_log_lines"))
        keeps_stage = F.col("s").isNotNull() & (F.col("p").isNull() | (F.col("s.seq") > F.col("p.seq")))
        return merged.select("task_id", "p.current", "p.total", "p.status", F.when(keeps_stage, F.col("s.stage")).alias("stage"), "n_log_lines")

    def _merge(self) -> None:
        digests = self.spark.readStream.schema(f"{DIGEST_SCHEMA}, batch_id long").parquet(f"{self.digests.path}/data/batch-*")
        registered = self.spark.readStream.schema("task_id long").parquet(self.registered).where("task_id IS NOT NULL")
        rows = _flat(digests).unionByName(registered, allowMissingColumns=True).select([F.col(f.split()[0]).cast(f.split()[1]) for f in _INPUT.split(", ")])
        # Time is that of the micro-batch, so no row is ever late; timers fire when
        # it has moved on. (In processing-time mode a query never runs out of batches.)
        timed = rows.withColumn("at", F.current_timestamp()).withWatermark("at", "0 seconds")
        merged = timed.groupBy("task_id").transformWithState(TaskRun(self.keep_ended_ms), RUN_SCHEMA, "Update", "EventTime")
        with _state_store(self.spark):
            query = (merged.writeStream.outputMode("update").foreachBatch(self.table.sink(self.compact_every, latest_runs))
                     .option("checkpointLocation", f"{self.root}/checkpoint-runs").trigger(availableNow=True).start())
            query.awaitTermination()

    def advance(self) -> None:
        self.digest()
        self._merge()

    def runs(self) -> DataFrame:
        return latest_runs(self.table.snapshot()).drop("batch_id")


def stream_task_log(spark: SparkSession, lines: str, root: str, compact_every: int = 10) -> AppendTable:
    """Log lines (task_id, seq, text) of the run output under ``lines`` in an
    append table, taken in up to now; called again, it goes on from there."""
    table = AppendTable(spark, f"{root.rstrip('/')}/log", "task_id long, seq long, text string")
    logged = parse_event_lines(stream_lines(spark, lines)).where(F.col("kind") == "log").select("task_id", "seq", "text")
    query = (logged.writeStream.foreachBatch(table.sink(compact_every))
             .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint-log").trigger(availableNow=True).start())
    query.awaitTermination()
    return table
