"""Removal of repeated word windows by difference-cover anchors.

A window of ``window`` words is repeated if its word sequence starts anywhere
else. Only anchors (shorter word sequences) at the positions of a difference
cover modulo a period are hashed: for any two positions some shift below the
period brings both onto the cover, so equal windows share an aligned anchor
of ``window - period + 1`` words.

1. Anchors found once are done with. Documents without a repeated anchor are
   finished here.
2. Extension, in one step: from every repeated anchor a longer sequence is
   hashed at the same cover position. Where it is repeated, all windows inside
   it are. Long matches are settled but for their ends.
3. Extension, word by word: each remaining window that holds a repeated
   anchor is hashed whole and counted, together with the windows inside one
   occurrence of each repeated longer sequence, which stand for all of them.

Hashes are counted with partial aggregation, so copies of a passage meet
pre-counted; the counts that matter are written to the shared checkpoint
folder and joined back to the occurrences, where adaptive execution can split
a hash that very many rows share. No pairs are made. Results rest on 128-bit
hashes (step 1 on 64 bits, where a clash only costs work).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches
from .ragged import OTHER_POWERS, batch_chunks, disjoint_hash, mix, prefix_sums, slice_hash

WINDOW_WORDS = 35
PERIOD = 21
#: Perfect difference sets by modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Words of the longer sequence of step 2, beyond the window.
EXTRA_WORDS = 20

_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def difference_cover(period: int) -> np.ndarray:
    """Residues of which two differ by any given amount modulo ``period``."""
    if period in COVERS:
        return np.array(COVERS[period])
    step = int(np.ceil(np.sqrt(period)))
    return np.array(sorted({*range(min(step, period)), *range(0, period, step)}))


class Words:
    """The words of a chunk of texts as byte ranges and 64-bit hashes."""

    def __init__(self, texts: list[str]) -> None:
        raws = [t.encode() for t in texts]
        self.raw = b"".join(raws)
        b = np.frombuffer(self.raw, np.uint8)
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        text_end = np.cumsum(size)
        solid = _SOLID[b]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        begin = (text_end - size)[size > 0]
        first[begin] = solid[begin]
        last[text_end[size > 0] - 1] = solid[text_end[size > 0] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Index of the first word of each text, and one past the last word.
        self.first = np.append(np.searchsorted(self.start, text_end - size), len(self.start))
        self.count = np.diff(self.first)
        self._values = _BYTES[b]
        self.hash = disjoint_hash(self._values, self.start, self.end)

    def one(self) -> tuple[np.ndarray, np.ndarray]:
        return prefix_sums(self.hash)

    def hashes(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the ``length`` words at each place,
        from two hashes of each word and over two bases."""
        other = prefix_sums(disjoint_hash(self._values, self.start, self.end, 0xA0761D6478BD642F), OTHER_POWERS)
        return tuple(slice_hash(*x, at, at + length).view(np.int64) for x in (self.one(), other))

    def joined(self, text: int, keep: np.ndarray | None = None) -> bytes:
        """The kept words of one text, joined by one space."""
        a, b = self.first[text], self.first[text + 1]
        s, e = self.start[a:b], self.end[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        raw = self.raw
        return b" ".join([raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)])


def _anchor_positions(n: int, anchor: int, period: int, cover: np.ndarray) -> np.ndarray:
    """Cover positions at which an anchor of a document of n words may start."""
    p = (np.arange(0, max(n - anchor + 1, 0), period)[:, None] + cover[None, :]).ravel()
    return p[p + anchor <= n]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part, texts in batch_chunks(batch, "text"):
        yield part, Words(texts)


def _anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(h, k, pos) of every anchor at a cover position; k is the row's key."""
    cover, anchor = difference_cover(period), window - period + 1

    def run(batches):
        for batch in batches:
            for part, words in _texts(batch):
                keys = part.column("k").to_numpy(zero_copy_only=False)
                places = [_anchor_positions(n, anchor, period, cover) if n >= window else cover[:0] for n in words.count.tolist()]
                size = np.fromiter(map(len, places), np.int64, len(places))
                pos = np.concatenate(places) if places else cover[:0]
                h = slice_hash(*words.one(), (at := pos + np.repeat(words.first[:-1], size)), at + anchor).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(keys, size)), pa.array(pos.astype(np.int32))], names=["h", "k", "pos"])

    return map_batches(docs.select("k", "text"), run, [("h", "long"), ("k", "long"), ("pos", "int")])


def _repeated(found: DataFrame, hashes: list[str], row: list[str], weight: str = "1", firsts: bool = False) -> DataFrame:
    """For each row the positions whose hash is found more than once (column
    ``places``), and with ``firsts`` those of them that are the first occurrence
    of their hash. Occurrences of a ``weight`` over one are known to be repeated
    and only vouch for others. Repeated rows share ``row``; they are sets of
    positions, made partly before the shuffle, so that any number of copies
    leaves one list bounded by the words of one."""
    place = F.struct("k", "pos")
    first = [F.min(place).alias("first")] if firsts else []
    twice = cut_lineage(found.groupBy(*hashes).agg(F.sum(F.expr(weight)).alias("n"), *first).where("n > 1").drop("n"))
    hits = found.where(F.expr(weight) == 1).join(twice, hashes)
    own = [F.collect_set(F.when(place == F.col("first"), F.col("pos"))).alias("firsts")] if firsts else []
    return cut_lineage(hits.groupBy(*row).agg(F.collect_set("pos").alias("places"), *own))


def _long_sequences(docs: DataFrame, length: int) -> DataFrame:
    """(h1, h2, id, k, pos) of the longer sequences from repeated anchors."""

    def run(batches):
        for batch in batches:
            for part, words in _texts(batch):
                places = [np.unique(np.array(p, np.int64)) for p in part.column("places").to_pylist()]
                places = [p[p + length <= n] for p, n in zip(places, words.count.tolist(), strict=True)]
                yield _hash_rows(part, words, places, length, 1)

    return map_batches(docs.select("id", "k", "text", "places"), run, _hash_fields(docs))


def _open_windows(docs: DataFrame, window: int, period: int, length: int) -> DataFrame:
    """(h1, h2, id, k, pos, weight) of windows that hold a repeated anchor and
    lie in no repeated longer sequence, and with weight 2 of the windows in
    first occurrences of longer sequences."""

    def run(batches):
        for batch in batches:
            for part, words in _texts(batch):
                open_, known = [], []
                lists = [part.column(c).to_pylist() for c in ("places", "settled", "firsts")]
                for anchors, settled, firsts, n in zip(*lists, words.count.tolist(), strict=True):
                    last, inside = n - window + 1, length - window + 1
                    candidates = _covered(np.array(anchors, np.int64) - period + 1, period, last)
                    open_.append(np.flatnonzero(candidates & ~_covered(np.array(settled or [], np.int64), inside, last)))
                    known.append(np.flatnonzero(_covered(np.array(firsts or [], np.int64), inside, last)))
                yield _hash_rows(part, words, open_, window, 1)
                yield _hash_rows(part, words, known, window, 2)

    return map_batches(docs.select("id", "k", "text", "places", "settled", "firsts"), run, _hash_fields(docs))


def _hash_fields(docs: DataFrame):
    return [("h1", "long"), ("h2", "long"), ("id", docs.schema["id"].dataType), ("k", "long"), ("pos", "int"), ("weight", "int")]


def _hash_rows(part: pa.RecordBatch, words: Words, places: list[np.ndarray], length: int, weight: int) -> pa.RecordBatch:
    size = np.fromiter(map(len, places), np.int64, len(places))
    pos = np.concatenate(places) if places else np.zeros(0, np.int64)
    h1, h2 = words.hashes(pos + np.repeat(words.first[:-1], size), length)
    owner = pa.array(np.repeat(np.arange(len(size)), size))
    return pa.RecordBatch.from_arrays(
        [pa.array(h1), pa.array(h2), part.column("id").take(owner), part.column("k").take(owner), pa.array(pos.astype(np.int32)),
         pa.array(np.full(len(pos), weight, np.int32))],
        names=["h1", "h2", "id", "k", "pos", "weight"])


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in some [start, start + length)."""
    n = max(n, 0)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts, 0, n), 1)
    np.add.at(edge, np.clip(starts + length, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW_WORDS, period: int = PERIOD, id_col: str = "doc_id",
                            text_col: str = "text", carried: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Remove every word covered by a window whose word sequence also starts
    anywhere else, in this row or another; windows are judged on the input.

    Returns the ``carried`` columns (the id by default), n_words, n_removed and the
    kept text: ``text``, the unchanged text where nothing was removed, else
    the kept words joined by one space; with ``digest`` instead
    ``kept_sha256`` of the kept words joined by one space.

    Null text has no words and stays null. Repeated rows are separate places
    of their words, so a repeated long row loses its windows. Rows shorter
    than a window are never changed. An empty table gives an empty result.
    Columns that are neither carried nor read do not matter, whatever their
    names.
    """
    carried = [id_col] if carried is None else carried
    src = docs.select(F.struct(*[F.col(c) for c in carried]).alias("rest"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("k", F.xxhash64("id", "text"))
    length = window + EXTRA_WORDS

    marks = _repeated(_anchors(src, window, period), ["h"], ["k"])
    seen = cut_lineage(_first_pass(src.join(marks, "k", "left"), window, digest))
    touched = seen.where("places IS NOT NULL")
    row = ["id", "k"]
    settled = _repeated(_long_sequences(touched, length), ["h1", "h2"], row, firsts=True)
    with_settled = _attach(touched, settled.withColumnRenamed("places", "settled"))
    single = _repeated(_open_windows(with_settled, window, period, length), ["h1", "h2"], row, "weight")
    both = (settled.select(*row, F.col("places").alias("settled"), F.lit(None).cast("array<int>").alias("single"))
            .unionByName(single.select(*row, F.lit(None).cast("array<int>").alias("settled"), F.col("places").alias("single")))
            .groupBy(*row).agg(F.max("settled").alias("settled"), F.max("single").alias("single")))
    done = _last_pass(_attach(touched, both), window, length, digest)
    result = seen.where("places IS NULL").select(*done.columns).unionByName(done)
    return result.select("rest.*", *[c for c in done.columns if c != "rest"])


def _attach(docs: DataFrame, marks: DataFrame) -> DataFrame:
    marks = marks.withColumnRenamed("id", "_id").withColumnRenamed("k", "_k")
    return docs.join(marks, (docs["k"] == marks["_k"]) & docs["id"].eqNullSafe(marks["_id"]), "left").drop("_id", "_k")


def _kept_field(digest: bool) -> str:
    return "kept_sha256" if digest else "text"


def _first_pass(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    """Finish rows without a repeated anchor; the others keep their text."""
    kept = _kept_field(digest)
    fields = [("rest", docs.schema["rest"].dataType), ("id", docs.schema["id"].dataType), ("k", "long"), ("places", "array<int>"),
              ("n_words", "long"), ("n_removed", "long"), (kept, "string")]
    fields += [("text", "string")] if digest else []

    def run(batches):
        for batch in batches:
            for part, words in _texts(batch):
                open_ = part.column("places").is_valid().to_pylist()
                text = part.column("text")
                columns = {c: part.column(c) for c in ("rest", "id", "k", "places")}
                columns |= {"n_words": pa.array(words.count), "n_removed": pa.array(np.zeros(len(open_), np.int64))}
                if digest:
                    columns[kept] = pa.array([None if o else hashlib.sha256(words.joined(i)).hexdigest() for i, o in enumerate(open_)], pa.string())
                    columns["text"] = pa.array([t if o else None for t, o in zip(text.to_pylist(), open_, strict=True)], pa.string())
                else:
                    columns["text"] = text
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_batches(docs.select("rest", "id", "k", "places", "text"), run, fields)


def _last_pass(docs: DataFrame, window: int, length: int, digest: bool) -> DataFrame:
    kept = _kept_field(digest)
    fields = [("rest", docs.schema["rest"].dataType), ("n_words", "long"), ("n_removed", "long"), (kept, "string")]

    def run(batches):
        for batch in batches:
            for part, words in _texts(batch):
                removed, texts = [], []
                whole = part.column("text").to_pylist()
                for i, (long_, short) in enumerate(zip(part.column("settled").to_pylist(), part.column("single").to_pylist(), strict=True)):
                    n = int(words.count[i])
                    out = _covered(np.array(long_ or [], np.int64), length, n) | _covered(np.array(short or [], np.int64), window, n)
                    removed.append(int(out.sum()))
                    if digest:
                        texts.append(hashlib.sha256(words.joined(i, ~out)).hexdigest())
                    else:
                        texts.append(words.joined(i, ~out).decode() if removed[-1] else whole[i])
                arrays = [part.column("rest"), pa.array(words.count), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["rest", "n_words", "n_removed", kept])

    return map_batches(docs.select("rest", "text", "settled", "single"), run, fields)
