"""Run output as a streaming (and batch) Python data source of raw text lines.

``run_lines`` reads growing text files under a folder. A position is a file and
a byte offset, always the start of a line: a line counts once its newline is
there, so a query that stops in the middle of a file goes on with the next
whole line, whatever the writer has half-written. Each file's new bytes are cut
into splits that tasks read on their own; a split begins with the first line
that starts in it.

Columns: ``task_id``; ``seq``, which grows along a task's lines (byte offset,
below the number of the part file, below that of a folder ``gen-N``); ``line``,
without its newline.
A line is ``<task id>TAB<text>``, or with ``tasks=file`` plain text in a file
named by its task (``task_17.log``). Lines without a valid task id have a null
one. Bytes that are not UTF-8 are replaced. Paths are anything that Arrow's
file systems open, so the folder need not be local.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "run_lines"
SCHEMA = "task_id long, seq long, line string"
#: Bytes a task reads at a time; a longer line is read whole.
SPLIT_BYTES = 32 << 20
#: Bits of ``seq`` below the part number (files up to 64 GB) and below the
#: folder's number (up to 2**18 parts).
PART_SHIFT, FOLDER_SHIFT = 36, 54
_TAIL = 1 << 16


class Folder:
    """The text files of a folder, by path below it."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, self.base = fs.FileSystem.from_uri(path)
        self.base = self.base.rstrip("/")

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        infos = self.files.get_file_info(fs.FileSelector(self.base, recursive=True, allow_not_found=True))
        names = ((i.path[len(self.base) + 1 :], i.size) for i in infos if i.type == fs.FileType.File)
        return {n: size for n, size in names if not any(part[0] in "._" for part in n.split("/"))}

    def open(self, name: str):
        return self.files.open_input_file(f"{self.base}/{name}")

    def end_of_lines(self, name: str, size: int, known: int) -> int:
        """Offset after the last newline, looked for from the end."""
        with self.open(name) as f:
            at = size
            while at > known:
                low = max(known, at - _TAIL)
                f.seek(low)
                found = f.read(at - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
        return known


def splits(start: dict[str, int], end: dict[str, int], split_bytes: int) -> list[InputPartition]:
    """(file, from, to, first line start of the range) of every split."""
    out = []
    for name in sorted(end):
        first, last = start.get(name, 0), end[name]
        out += [InputPartition((name, i, min(i + split_bytes, last), first)) for i in range(first, last, split_bytes)]
    return out


def read_split(folder: Folder, name: str, low: int, high: int, first: int, by_file: bool) -> Iterator:
    """Record batch of the lines that start in [low, high)."""
    import numpy as np
    import pyarrow as pa

    with folder.open(name) as f:
        begin = low if low == first else low - 1  # a newline just before the split starts a line in it
        f.seek(begin)
        data = f.read(high - begin)
        while not data.endswith(b"\n"):
            more = f.read(_TAIL)
            if not more:
                break
            at = more.find(b"\n")
            data += more if at < 0 else more[: at + 1]
    if low != first:
        at = data.find(b"\n")
        begin, data = (begin + at + 1, data[at + 1 :]) if at >= 0 else (high, b"")
    lines = data.split(b"\n")[:-1]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    offsets = begin + np.cumsum(lengths) - lengths
    inside = int(np.searchsorted(offsets, high))  # the split after this one has the others
    lines, offsets = lines[:inside], offsets[:inside]
    if by_file:
        found = re.search(r"(\d+)\D*$", name.rsplit("/", 1)[-1])
        tasks, texts = [int(found[1]) if found else None] * len(lines), lines
    else:
        cut = [x.partition(b"\t") for x in lines]
        tasks = [int(a) if tab and re.fullmatch(rb"-?[0-9]{1,18}", a) else None for a, tab, _ in cut]
        texts = [rest if tab else a for a, tab, rest in cut]
    part, generation = (int((re.search(rf"{word}-(\d+)", name) or [0, 0])[1]) for word in ("part", "gen"))
    yield pa.RecordBatch.from_arrays(
        [pa.array(tasks, pa.int64()), pa.array(offsets + (generation << FOLDER_SHIFT) + (part << PART_SHIFT)), pa.array([t.decode("utf-8", "replace").removesuffix("\r") for t in texts], pa.string())],
        names=["task_id", "seq", "line"])


class _Reading:
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.by_file = options.get("tasks", "prefix") == "file"
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))

    def read(self, partition: InputPartition) -> Iterator:
        yield from read_split(Folder(self.path), *partition.value, self.by_file)


class LineStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.ends: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        folder = Folder(self.path)
        for name, size in folder.sizes().items():
            seen, end = self.ends.get(name, (0, 0))
            if size > seen:
                self.ends[name] = size, folder.end_of_lines(name, size, end)
        return {name: end for name, (_, end) in sorted(self.ends.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return splits(start, end, self.split_bytes)


class LineReader(_Reading, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        folder = Folder(self.path)
        return splits({}, {n: folder.end_of_lines(n, size, 0) for n, size in folder.sizes().items()}, self.split_bytes)


class RunLines(DataSource):
    """``spark.readStream.format("run_lines").load(path)``, or ``spark.read``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineStreamReader(self.options)


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Unbounded (task_id, seq, line) of the files under ``path``."""
    spark.dataSource.register(RunLines)
    return spark.readStream.format(NAME).options(**options).load(path)


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(task_id, seq, line) of all whole lines there are now."""
    spark.dataSource.register(RunLines)
    return spark.read.format(NAME).options(**options).load(path)


def land_lines(lines: DataFrame, path: str, generation: int = 0) -> None:
    """Write (task_id, seq, line) as text files of ``<task id>TAB<line>`` to a
    folder of their own, a task's lines in order: a task may go on in the next
    part file, so that one with a third of all lines is written by many tasks.
    Lines that come after others have a higher ``generation``."""
    dealt = lines.repartitionByRange("task_id", "seq").sortWithinPartitions("task_id", "seq")
    text = F.concat(F.col("task_id").cast("string"), F.lit("\t"), F.col("line")).alias("value")
    dealt.select(text).write.mode("overwrite").text(f"{path.rstrip('/')}/gen-{generation:03d}")
