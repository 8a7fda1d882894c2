"""Nearest neighbours by multi-index hashing of learned binary codes.

1. Learning. On a bounded sample of the vectors (``SAMPLE_ROWS``, least hash of
   the id first) rotations are learned that bring the centred vectors close to
   the corners of a cube (alternating between signs and the best rotation onto
   them). A vector's code is the signs of its rotated components; several
   rotations from different starts give ``BITS`` bits.
2. Index. A code is split into ``TABLES`` substrings of 64 bits, each indexed:
   every vector has one entry per table, under the bucket named by the leading
   bits of its substring. Entries of a bucket are packed into blocks.
3. Probing. A query's radius is the Hamming distance of its ``NEAREST``-th code,
   read off the sample's codes. Two codes within radius r agree in one of the m
   substrings up to r // m bits (pigeonhole), so a query visits, per table, the
   buckets that differ from its own in at most as many leading bits, and there
   the entries whose substring is that close. What lies within the radius in
   the whole code is a candidate, reported by the first table that finds it.
4. Reranking. All candidates are compared by their original vectors. A query
   with too few candidates is searched again with a larger radius.

Every vector is indexed; nothing caps buckets or candidates. Queries meet the
index as blocks joined by (table, bucket), so a crowded bucket is many block
rows that adaptive execution can split. What is sent to all tasks, the
rotations and the sample's codes, has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches

#: Vectors that the rotations are learned from, and that radii are read off.
SAMPLE_ROWS = 20_000
BITS, TABLES = 512, 8
#: Codes that a query's radius should hold.
NEAREST = 200
#: The least rank in the sample at which a radius is read: of a sample far
#: smaller than the table a lower rank would be a matter of luck.
LEAST_RANK = 10
ROUNDS = 20
#: Leading bits that name a bucket, at most; fewer for small tables.
MOST_BUCKET_BITS = 6
INDEX_BLOCK, QUERY_BLOCK = 4096, 256
#: Entries a task holds before it hands out what it has packed.
HELD_ENTRIES = 1 << 18


class Model(NamedTuple):
    """What the searching tasks share."""

    dimension: int
    vectors: int
    mean: np.ndarray
    rotation: np.ndarray
    sample: np.ndarray
    rank: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, TABLES) words of the signs of the rotated components."""
        signs = (x - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1, bitorder="big").view(">u8").astype(np.uint64)

    @property
    def bucket_bits(self) -> int:
        return int(np.clip(np.log2(max(self.vectors, 1) / INDEX_BLOCK), 0, MOST_BUCKET_BITS))


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part: the id not null,
    the vector neither null, empty nor zero, all of its components finite."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))


def _rotation(x: np.ndarray, seed: int) -> np.ndarray:
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return r


def learn(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, nearest: int = NEAREST, seed: int = 0) -> Model | None:
    """Rotations from a bounded sample of (vec_id, vec); None without a vector.

    Vectors of another length than the most frequent one (the least of several)
    cannot be compared and are left out by ``search``."""
    lengths = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    d, n = int(lengths["d"]), int(lengths["count"])
    chosen = vectors.where(F.size("vec") == d).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "vec").limit(sample_rows)
    x = np.array([r["vec"] for r in chosen.collect()], np.float64)
    scale = np.abs(x).max() or 1.0
    mean = x.mean(axis=0)
    centred = (x - mean) / scale
    width = min(d, BITS)
    if d > BITS:  # the directions that spread the sample most
        _, directions = np.linalg.eigh(centred.T @ centred)
        base = directions[:, ::-1][:, :BITS]
    else:
        base = np.eye(d)
    turns = [base @ _rotation(centred @ base, seed + i) for i in range(-(-BITS // width))]
    model = Model(d, n, mean, np.hstack(turns)[:, :BITS], np.zeros((0, TABLES), np.uint64), 0)
    rank = max(LEAST_RANK, -(-nearest * len(x) // n))
    return model._replace(sample=model.codes(x), rank=min(rank, len(x)))


def _radii(model: Model, codes: np.ndarray) -> np.ndarray:
    """Hamming distance of each code to the ``rank``-th nearest of the sample."""
    out = np.zeros(len(codes), np.int64)
    for i, code in enumerate(codes):
        apart = np.bitwise_count(model.sample ^ code).sum(axis=1, dtype=np.int64)
        out[i] = np.partition(apart, model.rank - 1)[model.rank - 1]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Packer:
    """Collects entries by (table, bucket) and hands them out as packed blocks."""

    def __init__(self, size: int) -> None:
        self.size, self.held, self.total = size, {}, 0

    def add(self, key: tuple[int, int], entries: np.ndarray) -> Iterator[tuple]:
        self.held.setdefault(key, []).append(entries)
        self.total += len(entries)
        if self.total >= HELD_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for (table, bucket), parts in self.held.items():
            rows = np.concatenate(parts)
            for i in range(0, len(rows), self.size):
                yield table, bucket, np.ascontiguousarray(rows[i : i + self.size]).tobytes()
        self.held, self.total = {}, 0


def _blocks(found: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    for row in found:
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.binary())], names=names)


def index_blocks(vectors: DataFrame, model: Model) -> DataFrame:
    """(t, bucket, entries): id and code of every vector, in each table."""
    shared = vectors.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = Model(*shared.value), _Packer(INDEX_BLOCK)
        shift = np.uint64(63 - own.bucket_bits)
        for batch in batches:
            code = own.codes(_matrix(batch.column("vec"), own.dimension))
            entry = np.column_stack([batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), code])
            for t in range(TABLES):
                bucket = code[:, t] >> np.uint64(1) >> shift
                for b in np.unique(bucket):
                    yield from _blocks(packer.add((t, int(b)), entry[bucket == b]), ["t", "bucket", "entries"])
        yield from _blocks(packer.flush(), ["t", "bucket", "entries"])

    return map_batches(vectors, run, [("t", "int"), ("bucket", "long"), ("entries", "binary")])


def query_blocks(queries: DataFrame, model: Model, stretch: int = 1) -> DataFrame:
    """(t, bucket, probes): id, code and radius (``stretch`` times that of the
    sample) of every query, in each bucket that may hold what it seeks."""
    shared = queries.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = Model(*shared.value), _Packer(QUERY_BLOCK)
        shift = np.uint64(63 - own.bucket_bits)
        for batch in batches:
            code = own.codes(_matrix(batch.column("vec"), own.dimension))
            radius = np.minimum(_radii(own, code) * stretch + (stretch > 1), BITS)
            probe = np.column_stack([batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), code, radius.astype(np.uint64)])
            for t in range(TABLES):
                bucket = code[:, t] >> np.uint64(1) >> shift
                for b in range(1 << own.bucket_bits):
                    near = np.bitwise_count(bucket ^ np.uint64(b)) <= radius // TABLES
                    if near.any():
                        yield from _blocks(packer.add((t, b), probe[near]), ["t", "bucket", "probes"])
        yield from _blocks(packer.flush(), ["t", "bucket", "probes"])

    return map_batches(queries, run, [("t", "int"), ("bucket", "long"), ("probes", "binary")])


def _within(t: int, entries: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (query, vector) of the pairs within the query's radius that table
    ``t`` finds and no table before it."""
    code, wanted, radius = entries[:, 1:], probes[:, 1:-1], probes[:, -1].astype(np.int64)
    near = np.bitwise_count(code[None, :, t] ^ wanted[:, None, t]) <= (radius // TABLES)[:, None]
    q, v = np.nonzero(near)
    apart = np.bitwise_count(code[v] ^ wanted[q])
    earlier = (apart[:, :t] <= (radius[q] // TABLES)[:, None]).any(axis=1)
    keep = ~earlier & (apart.sum(axis=1, dtype=np.int64) <= radius[q]) & (entries[v, 0] != probes[q, 0])
    return probes[q[keep], 0].view(np.int64), entries[v[keep], 0].view(np.int64)


def candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(query_id, vec_id) of all codes within the radius of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, entries, wanted in zip(*(batch.column(c) for c in ("t", "entries", "probes")), strict=True):
                found = _within(
                    t.as_py(), np.frombuffer(entries.as_buffer(), np.uint64).reshape(-1, 1 + TABLES),
                    np.frombuffer(wanted.as_buffer(), np.uint64).reshape(-1, 2 + TABLES))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id"])

    return map_batches(index.join(probes, ["t", "bucket"]).select("t", "entries", "probes"), run, [("query_id", "long"), ("vec_id", "long")])


def _distances(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): Euclidean distance of ``wanted`` and ``vec``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(batch.column("vec")[0]) if batch.num_rows else 1
            gap = _matrix(batch.column("vec"), width) - _matrix(batch.column("wanted"), width)
            score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    return map_batches(pairs.select("query_id", "vec_id", "wanted", "vec"), run, [("query_id", "long"), ("vec_id", "long"), ("score", "double")])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, model: Model | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query
    row among the rows of ``vectors`` with another id, nearest first, ties by
    the smaller id; fewer only if there are fewer.

    Score is the Euclidean distance of the original vectors in double
    precision. Null ids, and vectors that are null, empty, zero, of another
    length than most or hold a null or non-finite component take no part. Rows
    that share an id are one: at its nearest vector, and as a query with its
    least one. An empty table gives an empty result; other columns are not
    read."""
    usable = usable_vectors(vectors, id_col, vector_col)
    model = learn(usable) if model is None else model
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("vec") == model.dimension)
    wanted = usable_vectors(queries, id_col, vector_col).where(F.size("vec") == model.dimension)
    wanted = wanted.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    index = cut_lineage(index_blocks(usable, model))
    found = cut_lineage(candidates(index, query_blocks(wanted, model)))
    stretch = 1
    while True:
        # Queries that the radius of the sample left short; an id counts once.
        counts = found.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
        short = wanted.join(counts.where(F.col("n") >= k).withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti")
        short = cut_lineage(short)
        if stretch > BITS or short.isEmpty():
            break
        stretch *= 2
        again = candidates(index, query_blocks(short, model, stretch))
        rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        found = cut_lineage(rest.unionByName(again))
    named = wanted.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("wanted"))
    scored = _distances(found.join(usable, "vec_id").join(named, "query_id"))
    each = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
