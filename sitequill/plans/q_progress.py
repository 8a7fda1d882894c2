"""Progress-event queries over run output synthesised from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table
from ..streaming import line_source as LS
from ..streaming import progress as PG
from ..streaming import task_runs as TR
from . import duck as D
from .registry import query

_STAGES = "[" + ", ".join(D.q(s) for s in PG.STAGES) + "]"

LINES_SQL = f"""
lines AS (
  SELECT user_id AS task_id, event_id AS seq,
    CASE event_type
      WHEN 'view' THEN '{PG.PREFIX} {{"type": "progress", "data": {{"current": ' || CAST(k AS VARCHAR)
                       || ', "total": 100, "status": "Smart Probing: ' || CAST(k AS VARCHAR) || '/100"}}}}'
      WHEN 'click' THEN '{PG.PREFIX} {{"type": "stage", "data": "' || {_STAGES}[(k % 4) + 1] || '"}}'
      WHEN 'error' THEN '{PG.PREFIX} {{"type": "progress", "data": '
      WHEN 'signup' THEN '   '
      ELSE event_type || ' item ' || CAST(k AS VARCHAR)
    END AS line
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), parsed AS (
  SELECT task_id, seq, line,
    starts_with(line, '{PG.PREFIX}') AS is_ev,
    CASE WHEN starts_with(line, '{PG.PREFIX}') THEN try(json(substr(line, {len(PG.PREFIX) + 1}))) END AS j
  FROM (SELECT task_id, seq, {D.py_strip('line')} AS line FROM lines) WHERE line <> ''
), ev AS (
  SELECT task_id, seq, is_ev, line,
    CASE WHEN NOT is_ev THEN 'log' WHEN json_extract_string(j, '$.type') IS NULL THEN 'bad' ELSE 'event' END AS kind,
    json_extract_string(j, '$.type') AS type,
    CASE WHEN json_extract_string(j, '$.type') = 'progress' THEN CAST(json_extract(j, '$.data.current') AS BIGINT) END AS current,
    CASE WHEN json_extract_string(j, '$.type') = 'progress' THEN CAST(json_extract(j, '$.data.total') AS BIGINT) END AS total,
    CASE WHEN json_extract_string(j, '$.type') = 'progress' THEN json_extract_string(j, '$.data.status') END AS status,
    CASE WHEN json_extract_string(j, '$.type') = 'stage' THEN json_extract_string(j, '$.data') END AS stage
  FROM parsed
)"""


def _parsed(spark, sf):
    events = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    return PG.parse_event_lines(PG.event_lines(events))


@query("parse_event_line", oracle=f"""
WITH {LINES_SQL}
SELECT task_id, seq, kind, type, current, total, status, stage, CASE WHEN NOT is_ev THEN line END AS text FROM ev""")
def parse_event_line(spark, sf):
    return _parsed(spark, sf)


_STATE_SQL = f"""
WITH {LINES_SQL},
p AS (SELECT task_id, arg_max(struct_pack(seq := seq, current := current, total := total, status := status), seq) AS p
      FROM ev WHERE type = 'progress' GROUP BY task_id),
s AS (SELECT task_id, arg_max(struct_pack(seq := seq, stage := stage), seq) AS s FROM ev WHERE type = 'stage' GROUP BY task_id),
a AS (SELECT task_id, count(*) FILTER (WHERE kind = 'log') AS n_log_lines, max(seq) AS last_seq FROM ev GROUP BY task_id)
SELECT a.task_id, p.p.current AS current, p.p.total AS total, p.p.status AS status,
  CASE WHEN s.s IS NOT NULL AND (p.p IS NULL OR s.s.seq > p.p.seq) THEN s.s.stage END AS stage,
  a.n_log_lines, a.last_seq
FROM a LEFT JOIN p ON p.task_id = a.task_id LEFT JOIN s ON s.task_id = a.task_id"""


@query("task_state", headline=True, oracle=_STATE_SQL)
def task_state(spark, sf):
    """Latest progress and stage per task (batch aggregate)."""
    return PG.task_state(_parsed(spark, sf))


@query("task_state_stream", oracle=_STATE_SQL)
def task_state_stream(spark, sf):
    """The same state maintained by a Structured Streaming aggregation over
    landed line files (availableNow trigger)."""
    events = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    source, state, ckpt = PG.scratch_dirs(spark, "progress")
    PG.write_line_files(PG.event_lines(events), source)
    return PG.stream_task_state(spark, source, state, ckpt)


@query("task_log", oracle=f"WITH {LINES_SQL} SELECT task_id, seq, line AS text FROM ev WHERE kind = 'log'")
def task_log(spark, sf):
    return PG.task_log(_parsed(spark, sf))


@query("stage_timeline", oracle=f"""
WITH {LINES_SQL}
SELECT task_id, seq, stage, lead(seq) OVER (PARTITION BY task_id ORDER BY seq) AS next_seq FROM ev WHERE type = 'stage'""")
def stage_timeline(spark, sf):
    return PG.stage_timeline(_parsed(spark, sf))


@query("progress_sampling", oracle=f"""
WITH {LINES_SQL}
SELECT task_id, seq, current, total FROM ev WHERE type = 'progress' AND (current % 5 = 0 OR current = total)""")
def progress_sampling(spark, sf):
    return PG.progress_sampling(_parsed(spark, sf))


@query("task_status", oracle=f"""
WITH last AS (
  SELECT user_id AS task_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id
)
SELECT task_id, CASE WHEN last_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN last_type = 'error' THEN 'Process exited with code 1' END AS error
FROM last""")
def task_status(spark, sf):
    """Run status per task from its output and exit line."""
    events = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    lines = PG.event_lines(events).unionByName(PG.exit_lines(events))
    return PG.task_status(lines)


@query("task_runs_stateful", oracle=_STATE_SQL.replace(
    "SELECT a.task_id, p.p.current AS current,",
    "SELECT a.task_id, CASE WHEN l.last_type = 'error' THEN 'failed' ELSE 'completed' END AS run_status, "
    "p.p.current AS current,").replace(
    "FROM a LEFT JOIN p ON p.task_id = a.task_id",
    "FROM a JOIN (SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id) l "
    "ON l.user_id = a.task_id LEFT JOIN p ON p.task_id = a.task_id"))
def task_runs_stateful(spark, sf):
    """Task state by a custom stateful streaming operator (applyInPandasWithState)
    that drops a task's state when its run exits."""
    events = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    return PG.stream_task_runs(spark, PG.event_lines(events), PG.exit_lines(events), PG.scratch_root(spark, "runs"))


def _landed_halves(events, path):
    """Run output as text files, the earlier half of the ids first."""
    half = events.agg(F.expr("(max(event_id) + min(event_id)) div 2")).first()[0] or 0
    lines = PG.event_lines(events)
    return [lambda: LS.land_lines(lines.where(F.col("seq") <= half), path, 0), lambda: LS.land_lines(lines.where(F.col("seq") > half), path, 1)]


@query("task_state_lines", oracle=_STATE_SQL.replace("a.n_log_lines, a.last_seq", "a.n_log_lines"))
def task_state_lines(spark, sf):
    """Task state from raw text lines, read by byte offsets: the stream stops
    after the first half of the files and goes on with the second."""
    events = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    runs = TR.TaskRuns(spark, PG.scratch_root(spark, "lines"))
    for land in _landed_halves(events, runs.lines):
        land()
        runs.digest()
    return runs.line_state()


@query("task_log_stream", oracle=f"WITH {LINES_SQL} SELECT task_id, line AS text FROM ev WHERE kind = 'log'")
def task_log_stream(spark, sf):
    """Log lines appended by a stream to a table with a manifest, exactly once."""
    events = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    root = PG.scratch_root(spark, "log")
    for land in _landed_halves(events, f"{root}/lines"):
        land()
        table = TR.stream_task_log(spark, f"{root}/lines", root, compact_every=2)
    return table.snapshot().select("task_id", "text")


@query("task_run_states", oracle=f"""
WITH {LINES_SQL}, exits AS (
  SELECT user_id AS task_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id
), p AS (SELECT task_id, arg_max(struct_pack(seq := seq, current := current, total := total, status := status), seq) AS p
      FROM ev WHERE type = 'progress' GROUP BY task_id),
s AS (SELECT task_id, arg_max(struct_pack(seq := seq, stage := stage), seq) AS s FROM ev WHERE type = 'stage' GROUP BY task_id),
a AS (SELECT task_id, count(*) FILTER (WHERE kind = 'log') AS n_log_lines FROM ev GROUP BY task_id),
t AS (SELECT c_custkey AS task_id FROM customer UNION SELECT user_id FROM events)
SELECT t.task_id, CASE WHEN a.task_id IS NULL THEN 'pending' WHEN last_type = 'error' THEN 'failed'
                       WHEN last_type = 'purchase' THEN 'completed' ELSE 'running' END AS run_status,
  CASE WHEN last_type = 'error' THEN 'Process exited with code 1' END AS error,
  p.p.current AS current, p.p.total AS total, p.p.status AS status,
  CASE WHEN s.s IS NOT NULL AND (p.p IS NULL OR s.s.seq > p.p.seq) THEN s.s.stage END AS stage,
  coalesce(a.n_log_lines, 0) AS n_log_lines
FROM t LEFT JOIN a ON a.task_id = t.task_id LEFT JOIN exits e ON e.task_id = t.task_id
LEFT JOIN p ON p.task_id = t.task_id LEFT JOIN s ON s.task_id = t.task_id""")
def task_run_states(spark, sf):
    """Runs of all registered tasks (every customer), merged from digests by
    ``transformWithState``; runs whose last event is an error or a purchase end."""
    events = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    runs = TR.TaskRuns(spark, PG.scratch_root(spark, "task-runs"))
    read_table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").cast("long").alias("task_id")).write.parquet(runs.registered)
    LS.land_lines(PG.event_lines(events), runs.lines)
    runs.advance()
    ending = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).where("last IN ('error', 'purchase')")
    LS.land_lines(PG.exit_lines(events).join(ending.select(F.col("user_id").alias("task_id")), "task_id", "left_semi"), runs.lines, 1)
    runs.advance()
    return runs.runs()
