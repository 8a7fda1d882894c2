"""Line source, append table and task runs: offsets, restarts, replays, timers."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitequill.streaming import line_source as LS
from sitequill.streaming import progress as PG
from sitequill.streaming import task_runs as TR
from sitequill.streaming.append_table import AppendTable

LINES = [(1, "hello"), (1, 'JSON-SINK: {"type": "progress", "data": {"current": 3, "total": 9, "status": "x"}}'), (2, "two"), (2, ""),
         (1, 'JSON-SINK: {"type": "stage", "data": "merging"}'), (3, "JSON-SINK: {bad"), (2, "  äö  ")]


def _text(lines):
    return "".join(f"{t}\t{x}\n" for t, x in lines).encode()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: b.replace(b"\n", b"").replace(b"\r", b"")), max_size=12), st.binary(max_size=6).map(lambda b: b.replace(b"\n", b"")), st.integers(1, 9))
def test_every_line_is_in_one_split(tmp_path_factory, lines, tail, split_bytes):
    folder = tmp_path_factory.mktemp("lines")
    data = b"".join(x + b"\n" for x in lines)
    (folder / "part-00002.txt").write_bytes(data + tail)
    f = LS.Folder(str(folder))
    end = f.end_of_lines("part-00002.txt", len(data + tail), 0)
    assert end == len(data)
    got = [r for p in LS.splits({}, {"part-00002.txt": end}, split_bytes) for b in LS.read_split(f, *p.value, False) for r in b.to_pylist()]
    at, want = 0, []
    for x in lines:
        want.append((at + (2 << LS.PART_SHIFT), x.partition(b"\t")[2 if b"\t" in x else 0].decode("utf-8", "replace")))
        at += len(x) + 1
    assert [(r["seq"], r["line"]) for r in got] == want


def test_ranges_start_where_the_last_one_ended(tmp_path):
    path = tmp_path / "task_17.log"
    path.write_bytes(b"one\ntwo\nthr")
    reader = LS.LineStreamReader({"path": str(tmp_path), "tasks": "file"})
    first = reader.latestOffset()
    path.write_bytes(b"one\ntwo\nthree\nfour\n")
    (tmp_path / "_hidden").write_bytes(b"x\n")
    second = reader.latestOffset()
    assert first == {"task_17.log": 8} and second == {"task_17.log": 19}
    read = lambda a, b: [r for p in reader.partitions(a, b) for x in reader.read(p) for r in x.to_pylist()]
    assert [(r["task_id"], r["seq"], r["line"]) for r in read(first, second)] == [(17, 8, "three"), (17, 14, "four")]
    assert [r["line"] for r in read({}, first)] == ["one", "two"]


def test_state_and_log_after_a_restart_in_mid_file(spark, tmp_path):
    data = _text(LINES)
    runs = TR.TaskRuns(spark, str(tmp_path))
    os.makedirs(runs.lines)
    path = os.path.join(runs.lines, "part-00000.txt")
    for end in (len(data) // 2, len(data)):  # the first cut is in mid-line
        with open(path, "wb") as f:
            f.write(data[:end])
        TR.TaskRuns(spark, str(tmp_path)).digest()
        table = TR.stream_task_log(spark, runs.lines, str(tmp_path), compact_every=2)
    batch = PG.parse_event_lines(LS.read_lines(spark, runs.lines))
    assert sorted(map(tuple, runs.line_state().collect()), key=str) == sorted(map(tuple, PG.task_state(batch).drop("last_seq").collect()), key=str)
    assert sorted(map(tuple, table.snapshot().drop("batch_id").collect())) == sorted(map(tuple, PG.task_log(batch).collect()))
    assert [r["kind"] for r in table.manifest().orderBy("committed").collect()] == ["batch", "batch", "compact"]


def test_replayed_and_unfinished_batches(spark, tmp_path):
    table = AppendTable(spark, str(tmp_path), "x long")
    one = lambda n: spark.range(n).withColumnRenamed("id", "x")
    assert table.snapshot().count() == 0
    assert table.append(one(3), 0) and not table.append(one(3), 0)
    one(50).write.parquet(f"{tmp_path}/data/batch-0000000001")  # died before its manifest row
    assert table.snapshot().count() == 3
    assert table.append(one(2), 1) and table.snapshot().count() == 5
    table.compact()
    assert not table.append(one(9), 1) and table.snapshot().count() == 5  # replayed after a compaction
    assert table.live_folders() == ["data/compact-0000000001"]
    assert table.append(one(1), 2) and table.snapshot().count() == 6
    table.compact(lambda rows: rows.where("x = 0"))
    assert sorted((r.x, r.batch_id) for r in table.snapshot().collect()) == [(0, 0), (0, 1), (0, 2)]


def test_pending_running_and_ended_runs(spark, tmp_path):
    """From registration to exit; a digest that comes twice counts once; the
    state of an ended run is dropped by its timer."""
    runs = TR.TaskRuns(spark, str(tmp_path), keep_ended_ms=0, compact_every=2)
    os.makedirs(runs.lines)
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "task_id long").write.parquet(runs.registered)
    path = os.path.join(runs.lines, "part-00000.txt")

    def advance(lines):
        with open(path, "ab") as f:
            f.write(_text(lines))
        runs.advance()
        return {r.task_id: (r.run_status, r.error, r.current, r.stage, r.n_log_lines) for r in runs.runs().collect()}

    got = advance(LINES[:4])
    assert got == {1: ("running", None, 3, None, 1), 2: ("running", None, None, None, 1), 3: ("pending", None, None, None, 0), 4: ("pending", None, None, None, 0)}
    # The same digests landed once more, as by a replay under new file names.
    runs.digests.snapshot().write.parquet(f"{runs.digests.path}/data/batch-0000000099")
    got = advance([*LINES[4:], (1, "EXIT 0"), (2, "EXIT 3")])
    assert got == {1: ("completed", None, 3, "merging", 1), 2: ("failed", "Process exited with code 3", None, None, 2),
                   3: ("running", None, None, None, 0), 4: ("pending", None, None, None, 0)}
    # The timers of runs 1 and 2 have fired by now: what comes after starts from nothing.
    got = advance([(4, "late start")])
    assert got[4] == ("running", None, None, None, 1) and got[1][0] == "completed"
    assert advance([(1, "again")])[1] == ("running", None, None, None, 1)


@pytest.mark.parametrize("order", [1, -1])
def test_raw_lines_are_combined_before_python(spark, order):
    lines = spark.createDataFrame([(t, i * order, x) for i, (t, x) in enumerate(LINES)], "task_id long, seq long, line string")
    plan = TR.digest_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Python" not in plan and "Pandas" not in plan


class _Handle:
    """Stands for the state of one task; notes each call, as each is a round trip."""

    def __init__(self):
        self.calls, self.held, self.timers = [], None, []

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name == "update":
                self.held = given[0]
            elif name == "registerTimer":
                self.timers.append(given[0])
            elif name == "deleteTimer":
                self.timers.remove(given[0])
            return {"exists": self.held is not None, "get": self.held, "listTimers": self.timers}.get(name)

        return call


class _Times:
    def getCurrentWatermarkInMs(self):
        return 0


def test_few_state_calls_a_task():
    from datetime import UTC, datetime

    from pyspark.sql import Row

    handle, run = _Handle(), TR.TaskRun(1000)
    run.init(handle)
    names = [f.split()[0] for f in TR._INPUT.split(", ")]

    def step(at, **digest):
        handle.calls.clear()
        row = Row(*names, "at")(*(({"task_id": 7} | digest).get(n) for n in names), datetime.fromtimestamp(at, UTC))
        (out,) = run.handleInputRows((7,), iter([row]), _Times())
        return out.asDict(), handle.calls

    big = 2**53 + 1
    out, calls = step(1)
    assert (out["run_status"], calls) == ("pending", ["exists", "update"])
    out, calls = step(2, batch_id=0, p_seq=1, current=big, total=None, n_log_lines=2)
    assert (out["run_status"], out["current"], out["total"], out["n_log_lines"], calls) == ("running", big, None, 2, ["exists", "get", "update"])
    out, calls = step(3, batch_id=1, n_log_lines=0, e_seq=9, code=4)
    assert (out["run_status"], out["error"], calls) == ("failed", "Process exited with code 4", ["exists", "get", "update", "registerTimer"])
    assert step(4, batch_id=2, n_log_lines=1)[1] == ["exists", "get", "update", "listTimers", "deleteTimer", "registerTimer"]
    assert handle.timers == [5000]


def test_stateful_runs_take_digests(spark, tmp_path, monkeypatch):
    """Python folds one row per task and micro-batch, however many lines there
    are; a task without an id is no task; large numbers stay as they are."""
    fold, noted, big = PG._stateful_update, str(tmp_path / "noted"), 2**53 + 1

    def noting(key, batches, state):
        batches = list(batches)
        with open(noted, "a") as f:
            f.write(f"{key[0]} {sum(map(len, batches))}\n")
        yield from fold(key, iter(batches), state)

    monkeypatch.setattr(PG, "_stateful_update", noting)
    report = 'JSON-SINK: {"type": "progress", "data": {"current": %d, "status": "s"}}'
    lines = [(1, big + i, "log") for i in range(500)] + [(1, big + 500, report % big), (1, 3, report % 1), (2, 1, 'JSON-SINK: {"type": "stage", "data": "merging"}'),
             (2, 2, " "), (3, 5, "EXIT x"), (4, 1, "  "), (None, 6, "lost")]
    schema = "task_id long, seq long, line string"
    got = PG.stream_task_runs(spark, spark.createDataFrame(lines, schema), spark.createDataFrame([(1, big + 501, "EXIT 0"), (2, 3, "EXIT -2")], schema), str(tmp_path / "run"))
    assert sorted(map(tuple, got.collect())) == [
        (1, big, None, "s", None, 500, big + 500, "completed"), (2, None, None, None, "merging", 0, 1, "failed"),
        (3, None, None, None, None, 1, 5, "running")]
    taken = [tuple(map(int, x.split())) for x in open(noted)]
    assert {t for t, _ in taken} == {1, 2, 3} and all(n <= 2 for _, n in taken)  # two micro-batches of lines
