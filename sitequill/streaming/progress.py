"""Progress events of download runs: parsing, per-task state, logs, timelines.

A run's output is a sequence of lines per task. Lines starting ``JSON-SINK:``
carry ``{"type": "progress"|"stage", "data": ...}``; malformed JSON is
ignored; any other non-blank line is a log line. Per task, a ``progress``
event replaces the progress record (dropping a stage set earlier) and a
``stage`` event sets the record's stage.

The same state logic runs as a batch aggregate and as a Structured Streaming
aggregation (file source, ``availableNow`` trigger, complete mode, written by
``foreachBatch``); both give one row per task. No watermark: events carry no
event time, state is keyed by task and ordered by ``seq``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators.scan import neighbor_value
from ..session import ensure_checkpoint_dir

PREFIX = "JSON-SINK:"
# The stages a run reports, in order.
STAGES = ["analyzing", "probing", "downloading", "merging"]
EVENT_SCHEMA = "type string, data string"
PROGRESS_SCHEMA = "current long, total long, status string"
LINE_SCHEMA = "task_id long, seq long, line string"


def event_lines(events: DataFrame) -> DataFrame:
    """Synthesise run output from the ``events`` table: task = user, seq = event id.

    view -> progress event (current = props.k of 100), click -> stage event,
    error -> malformed event line, signup -> blank line, other -> log line.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.pmod(k, F.lit(len(STAGES))) + 1).cast("int"))
    line = (
        F.when(F.col("event_type") == "view", F.concat(
            F.lit(PREFIX + ' {"type": "progress", "data": {"current": '), k.cast("string"),
            F.lit(', "total": 100, "status": "Smart Probing: '), k.cast("string"), F.lit('/100"}}')))
        .when(F.col("event_type") == "click", F.concat(F.lit(PREFIX + ' {"type": "stage", "data": "'), stage, F.lit('"}')))
        .when(F.col("event_type") == "error", F.lit(PREFIX + ' {"type": "progress", "data": '))
        .when(F.col("event_type") == "signup", F.lit("   "))
        .otherwise(F.concat(F.col("event_type"), F.lit(" item "), k.cast("string")))
    )
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), line.alias("line"))


def exit_lines(events: DataFrame) -> DataFrame:
    """One ``EXIT <code>`` line per task after its last event: code 1 when the
    last event was an error, else 0 (the process exit the runner observes)."""
    last = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"),
                                         F.max("event_id").alias("last_seq"))
    return last.select(F.col("user_id").alias("task_id"), (F.col("last_seq") + 1).alias("seq"),
                       F.concat(F.lit("EXIT "), F.when(F.col("last_type") == "error", F.lit("1"))
                                .otherwise(F.lit("0"))).alias("line"))


def task_status(lines: DataFrame) -> DataFrame:
    """pending (no output) / running (output, no exit) / completed / failed."""
    t = lines.select("task_id", "seq", TX.py_strip("line").alias("line"))
    ex = t.where(F.col("line").rlike(r"^EXIT -?[0-9]+$")).groupBy("task_id").agg(
        F.max_by(F.substring("line", 6, 20).cast("int"), "seq").alias("code"))
    seen = t.where(F.col("line") != "").select("task_id").distinct()
    j = seen.join(ex, "task_id", "left")
    status = (F.when(F.col("code").isNull(), F.lit("running"))
              .when(F.col("code") == 0, F.lit("completed")).otherwise(F.lit("failed")))
    err = F.when(F.col("code") != 0, F.concat(F.lit("Process exited with code "), F.col("code").cast("string")))
    return j.select("task_id", status.alias("status"), err.alias("error"))


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """(task_id, seq, kind, type, current, total, status, stage, text).

    kind: ``event`` (well-formed JSON-SINK), ``bad`` (malformed), ``log``;
    blank lines are dropped.
    """
    t = lines.select("task_id", "seq", TX.py_strip("line").alias("line")).where(F.col("line") != "")
    is_ev = F.col("line").startswith(PREFIX)
    payload = TX.py_strip(F.substring(F.col("line"), len(PREFIX) + 1, 1 << 30))
    ev = F.from_json(F.when(is_ev, payload), EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    prog = F.from_json(ev["data"], PROGRESS_SCHEMA)
    kind = F.when(~is_ev, F.lit("log")).when(ev["type"].isNull(), F.lit("bad")).otherwise(F.lit("event"))
    return t.select(
        "task_id", "seq", kind.alias("kind"), ev["type"].alias("type"),
        F.when(ev["type"] == "progress", prog["current"]).alias("current"),
        F.when(ev["type"] == "progress", prog["total"]).alias("total"),
        F.when(ev["type"] == "progress", prog["status"]).alias("status"),
        F.when(ev["type"] == "stage", ev["data"]).alias("stage"),
        F.when(~is_ev, F.col("line")).alias("text"),
    )


def _state_aggs() -> list[Column]:
    last_prog = F.max(F.when(F.col("type") == "progress",
                             F.struct("seq", "current", "total", "status")))
    last_stage = F.max(F.when(F.col("type") == "stage", F.struct("seq", "stage")))
    return [last_prog.alias("p"), last_stage.alias("s"),
            F.count(F.when(F.col("kind") == "log", 1)).alias("n_log_lines"), F.max("seq").alias("last_seq")]


def _state_select(agg: DataFrame) -> DataFrame:
    stage_kept = F.col("s").isNotNull() & (F.col("p").isNull() | (F.col("s.seq") > F.col("p.seq")))
    return agg.select(
        "task_id", F.col("p.current").alias("current"), F.col("p.total").alias("total"),
        F.col("p.status").alias("status"), F.when(stage_kept, F.col("s.stage")).alias("stage"),
        "n_log_lines", "last_seq")


def task_state(parsed: DataFrame) -> DataFrame:
    """Per task: latest progress (current, total, status), the stage if set
    after it, log line count and last sequence number. A hash aggregate with
    map-side partials: a task with a third of all lines is combined early."""
    return _state_select(parsed.groupBy("task_id").agg(*_state_aggs()))


def task_log(parsed: DataFrame) -> DataFrame:
    """Log lines as rows (task_id, seq, text), never collected per task."""
    return parsed.where(F.col("kind") == "log").select("task_id", "seq", "text")


def stage_timeline(parsed: DataFrame) -> DataFrame:
    """Stage events per task with the sequence number of the next stage
    (``scan.neighbor_value``: no window holds a whole task)."""
    s = parsed.where(F.col("type") == "stage").select("task_id", "seq", "stage")
    return neighbor_value(s, "task_id", ["seq"], "seq", "next_seq", direction="next").select(
        "task_id", "seq", "stage", "next_seq")


def progress_sampling(parsed: DataFrame, every: int = 5) -> DataFrame:
    """Progress events that would be reported: every ``every``-th completion and the last."""
    p = parsed.where(F.col("type") == "progress")
    return p.where((F.pmod(F.col("current"), F.lit(every)) == 0) | (F.col("current") == F.col("total"))).select(
        "task_id", "seq", "current", "total")


# -- streaming -------------------------------------------------------------------

def write_line_files(lines: DataFrame, path: str, n_files: int = 8) -> None:
    """Land run output as JSON line files (the stream's source folder)."""
    lines.repartition(n_files).write.mode("overwrite").json(path)


def stream_task_state(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str) -> DataFrame:
    """Run the task-state aggregation as a stream over ``source_dir`` until all
    available files are processed. Each micro-batch writes only the tasks it
    changed, into its own folder (a replayed batch overwrites that folder);
    the state of a task is its row in the latest batch that has one."""
    src = spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", 2).json(source_dir)
    agg = parse_event_lines(src).groupBy("task_id").agg(*_state_aggs())

    def write(batch: DataFrame, batch_id: int) -> None:
        _state_select(batch).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_rows(spark.read.parquet(out_dir))


def latest_rows(rows: DataFrame) -> DataFrame:
    """The row of each task from the last micro-batch (``batch_id``) that has one."""
    cols = [c for c in rows.columns if c not in ("task_id", "batch_id")]
    latest = rows.groupBy("task_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("r"))
    return latest.select("task_id", *[F.col("r." + c).alias(c) for c in cols])


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch_dirs(spark: SparkSession, name: str) -> tuple[str, str, str]:
    root = scratch_root(spark, name)
    return os.path.join(root, "source"), os.path.join(root, "state"), os.path.join(root, "checkpoint")


# -- custom stateful operator -------------------------------------------------------

EXIT_RE = r"^EXIT (-?[0-9]+)$"
STATEFUL_OUT = ("task_id long, current long, total long, status string, stage string, n_log_lines long, "
                "last_seq long, run_status string")
DIGEST_SCHEMA = "task_id long, digest string"
STATEFUL_STATE = ("p_seq long, current long, total long, status string, s_seq long, stage string, "
                  "n_log long, last_seq long")


def run_digests(lines: DataFrame) -> DataFrame:
    """One row per task of (task_id, seq, line): ``digest``, a JSON object of its
    latest progress, stage and exit, its last line and its number of log lines.
    As text, numbers reach Python as they are: a column with nulls would be one
    of floats there."""
    parsed = parse_event_lines(lines).where("task_id IS NOT NULL")
    is_exit = F.coalesce(F.col("text").rlike(EXIT_RE), F.lit(False))
    found = parsed.groupBy("task_id").agg(
        F.max(F.when(F.col("type") == "progress", F.struct("seq", "current", "total", "status"))).alias("p"),
        F.max(F.when(F.col("type") == "stage", F.struct("seq", "stage"))).alias("s"),
        F.count(F.when((F.col("kind") == "log") & ~is_exit, 1)).alias("n_log"),
        F.max(F.when(~is_exit, F.col("seq"))).alias("last_seq"),
        F.max(F.when(is_exit, F.struct("seq", F.regexp_extract("text", EXIT_RE, 1).alias("code")))).alias("ended"))
    return found.select("task_id", F.to_json(F.struct("p", "s", "n_log", "last_seq", "ended")).alias("digest"))


def _stateful_update(key, batches, state):
    """Fold one task's new digests into its state; emit the task's row; drop the
    state once the exit line has been seen (the run is over)."""
    import json

    import pandas as pd

    if state.exists:
        p_seq, cur, tot, st, s_seq, stage, n_log, last = state.get
    else:
        p_seq = cur = tot = st = s_seq = stage = None
        n_log, last = 0, None
    ended = None
    for digest in (json.loads(d) for pdf in batches for d in pdf["digest"]):
        p, s, top, end = (digest.get(x) for x in ("p", "s", "last_seq", "ended"))
        n_log += digest["n_log"]
        if top is not None:
            last = top if last is None else max(last, top)
        if p and (p_seq is None or p["seq"] > p_seq):
            p_seq, cur, tot, st = (p.get(x) for x in ("seq", "current", "total", "status"))
        if s and (s_seq is None or s["seq"] > s_seq):
            s_seq, stage = s["seq"], s.get("stage")
        if end and (ended is None or end["seq"] > ended["seq"]):
            ended = end
    code = None if ended is None else int(ended["code"])

    keep_stage = s_seq is not None and (p_seq is None or s_seq > p_seq)
    run_status = "running" if code is None else ("completed" if code == 0 else "failed")
    if code is None:
        state.update((p_seq, cur, tot, st, s_seq, stage, n_log, last))
    else:
        state.remove()

    yield pd.DataFrame([{
        "task_id": int(key[0]), "current": cur, "total": tot, "status": st,
        "stage": stage if keep_stage else None, "n_log_lines": n_log, "last_seq": last,
        "run_status": run_status,
    }])


def stream_task_runs(spark: SparkSession, lines: DataFrame, exits: DataFrame, root: str) -> DataFrame:
    """Per-task state kept by ``applyInPandasWithState`` and dropped when a run
    exits. Run output is landed first and each task's exit line afterwards (a
    later micro-batch), as a process prints before it exits. A first query writes
    one digest per task and micro-batch of lines (built-in aggregates, combined
    before the shuffle), so raw lines never reach Python; the second folds the
    digests into the state. It starts when the first has ended, so no micro-batch
    of digests is replayed after it was read. Each trigger appends its updated
    rows; the result is the latest row per task."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    source, digests, out = (os.path.join(root, d) for d in ("source", "digests", "out"))

    def run(rows, write, checkpoint):
        q = (rows.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", os.path.join(root, checkpoint)).trigger(availableNow=True).start())
        q.awaitTermination()

    def run_once():
        src = spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", 4).json(source)
        run(src, lambda b, i: run_digests(b).write.mode("overwrite").parquet(f"{digests}/batch-{i:010d}"), "checkpoint-digests")
        new = spark.readStream.schema(DIGEST_SCHEMA).parquet(f"{digests}/batch-*")
        runs = new.groupBy("task_id").applyInPandasWithState(
            _stateful_update, STATEFUL_OUT, STATEFUL_STATE, "update", GroupStateTimeout.NoTimeout)
        run(runs, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), "checkpoint")

    lines.repartition(8).write.mode("append").json(source)
    run_once()
    exits.repartition(2).write.mode("append").json(source)
    run_once()
    return latest_rows(spark.read.parquet(out))
