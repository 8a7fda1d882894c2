"""Bounded-space online packing of documents into training sequences.

Each partition keeps a fixed number of open windows. A document's full
windows are emitted at once; its remainder goes best-fit into the open window
it fills most; when it fits none, the fullest window is emitted and a new one
opened. What is still open at a partition's end is left over: leftovers of
neighbouring partitions (a fixed number of them, so a bounded group) are
merged best-fit, and windows that are still not full are cut at powers of
two, which need no padding.

The first pass is written to the shared checkpoint folder, so a lost executor
cannot make the two reads of it disagree.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, id_text, map_batches

SEQUENCE_TOKENS = 2048
OPEN_WINDOWS = 64
#: Partitions whose leftovers are merged together.
MERGED_PARTITIONS = 16
#: A merged window this much short of full is cut at powers of two instead of padded.
SHORT_OF_FULL = 16

_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class BestFit:
    """Windows by fill; ``place`` returns the fullest one with room."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.fills, self.names = capacity, [], []

    def __len__(self) -> int:
        return len(self.fills)

    def place(self, size: int):
        """(window, fill before) or None if no window has room."""
        i = bisect.bisect_right(self.fills, self.capacity - size) - 1
        if i < 0:
            return None
        fill, name = self.fills.pop(i), self.names.pop(i)
        if fill + size < self.capacity:
            self.put(name, fill + size)
        return name, fill

    def put(self, name: int, fill: int) -> None:
        i = bisect.bisect_right(self.fills, fill)
        self.fills.insert(i, fill)
        self.names.insert(i, name)

    def pop_fullest(self) -> int:
        self.fills.pop()
        return self.names.pop()


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int = 1, capacity: int = SEQUENCE_TOKENS,
                   open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its ids and ``end_id``; null or empty text is the end id
    alone. Every id lies in exactly one piece and a sequence holds at most
    ``capacity`` ids. Repeated rows and null ids are packed as documents of
    their own; an empty table gives an empty result; other columns are not
    read.
    """
    src = id_text(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"),
              ("sequence_id", "long"), ("offset", "long"), ("part", "long"), ("ids", "binary")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield from _fill_windows(batches, part, vocabulary_path, end_id, capacity, open_windows)

    packed = cut_lineage(map_batches(src, fill, fields))
    ready = packed.where("part IS NULL").select(*_OUT)
    left = packed.where("part IS NOT NULL").withColumn("merged", F.floor(F.col("part") / MERGED_PARTITIONS))

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        return _merge_leftovers(key[0].as_py(), pieces, capacity)

    schema = T.StructType([f for f in packed.schema.fields if f.name in _OUT])
    return ready.unionByName(left.groupBy("merged").applyInArrow(merge, schema))


def _fill_windows(batches, part, path, end_id, capacity, open_windows):
    from .bpe import encoder
    from .ragged import batch_chunks

    enc = encoder(path)
    rows: list[tuple] = []
    held: dict[int, list[tuple]] = {}  # pieces of each open window
    fit = BestFit(capacity)
    made = part << 33
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for chunk, texts in batch_chunks(batch, "text"):
            ids, bounds = enc.token_ids(texts)
            bounds = bounds.tolist()
            for name, a, b in zip(chunk.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                own = np.append(ids[a:b], end_id).astype("<u4")
                n, at = len(own), 0
                while n - at >= capacity:
                    rows.append((name, at, capacity, zlib.crc32(own[at : at + capacity].tobytes()), n, made, 0, None, None))
                    made += 1
                    at += capacity
                if at == n:
                    continue
                rest = own[at:].tobytes()
                size = n - at
                found = fit.place(size)
                if found is None:
                    if len(fit) == open_windows:
                        rows += held.pop(fit.pop_fullest())
                    window, offset = made, 0
                    made += 1
                    fit.put(window, size)
                    held[window] = []
                else:
                    window, offset = found
                held[window].append((name, at, size, zlib.crc32(rest), n, window, offset, None, rest))
                if offset + size == capacity:
                    rows += held.pop(window)
            if len(rows) >= 4096:
                yield _rows(rows, kind, False)
                rows = []
    if kind is not None:
        yield _rows(rows, kind, False)
        yield _rows([(*r[:7], part, r[8]) for w in held.values() for r in w], kind, True)


def _rows(rows: list[tuple], kind: pa.DataType, leftover: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:8])]
    arrays.append(pa.array(columns[8] if leftover else [None] * len(rows), pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=[*_OUT, "part", "ids"])


def _merge_leftovers(group: int, pieces: pa.Table, capacity: int) -> pa.Table:
    """Best-fit by falling length; short windows cut at powers of two."""
    kind = pieces.schema.field("doc_id").type
    rows = list(zip(*(pieces.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")), strict=True))
    rows.sort(key=lambda r: (-r[2], r[5], r[6]))
    fit = BestFit(capacity)
    windows: list[list[tuple]] = []
    for name, start, size, n, raw, _, _ in rows:
        found = fit.place(size)
        if found is None:
            fit.put(len(windows), size)
            windows.append([])
            window = len(windows) - 1
        else:
            window = found[0]
        windows[window].append((name, start, size, n, raw))
    made = (1 << 61) + (group << 33)
    out: list[tuple] = []
    for window in windows:
        total = sum(p[2] for p in window)
        full = total > capacity - SHORT_OF_FULL
        room = [total] if full else [1 << i for i in reversed(range(total.bit_length())) if total >> i & 1]
        offset = 0
        for name, start, size, n, raw in window:
            at = 0
            while at < size:
                take = min(size - at, room[0] - offset)
                out.append((name, start + at, take, zlib.crc32(raw[4 * at : 4 * (at + take)]), n, made, offset))
                at += take
                offset += take
                if offset == room[0]:
                    room.pop(0)
                    made += 1
                    offset = 0
    columns = list(zip(*out, strict=True)) or [[]] * len(_OUT)
    return pa.table([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=_OUT)
