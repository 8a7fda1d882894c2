"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Fewer
than three differing bits leave at least one segment untouched (pigeonhole),
and the following segment then differs in at most two bits. Words of the
binary Golay code [23, 12] fill the space in balls of radius 3, so every
vector decodes to one codeword; the codewords to which a segment and its
one-bit neighbours decode give a few 12-bit indices (mostly six), and two
segments at most two bits apart share one, since a vector between them is a
neighbour of both. A key is therefore (which segment is untouched, its bits,
one index of the following segment); fingerprints that meet at a key are
verified by their exact distance.

Only distinct fingerprints are compared, so copies cost nothing. A key that
very many fingerprints share never has its pairs listed: there each
fingerprint is tied to the vectors at distance one or none, and those that
meet at such a vector (exactly those at most two bits apart) are tied to the
least one. Components of the ties are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_text, map_batches, row_key
from .components import connected_components
from .ragged import batch_chunks

#: (lowest bit, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code,
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Fingerprints at one key up to which its pairs are compared directly.
DIRECT_KEY = 64
#: Bits by which linked fingerprints may differ; the keys find up to two.
MAX_BITS = 2


def fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    """Majority of the bits of all shingles' XXH64; no words: 0."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), end[k - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, fp): the fingerprint as a signed long, row by row.

    A-Z are lowered; words are runs of characters other than ASCII white
    space. ``row`` identifies rows that share an id. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in batch_chunks(batch, "text"):
                fps = [fingerprint(t.encode().lower().split(), shingle, seed) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "row", "fp"])

    src = id_text(docs, id_col, text_col).withColumn("row", row_key())
    return map_batches(src.select("doc_id", "text", "row"), run, [("doc_id", src.schema["doc_id"].dataType), ("row", "long"), ("fp", "long")])


@lru_cache(maxsize=1)
def _golay_errors() -> np.ndarray:
    """Error pattern of weight 3 or less for each of the 2048 syndromes."""
    one = 1 << np.arange(23)
    patterns = [0, *one]
    patterns += [a | b for i, a in enumerate(one) for b in one[i + 1 :]]
    patterns += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[i + 1 :], i + 1) for c in one[j + 1 :]]
    p = np.array(patterns, np.int64)
    table = np.zeros(2048, np.int64)
    table[_syndrome(p)] = p
    return table


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
    return x


def golay_index(x: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (x ^ _golay_errors()[_syndrome(x)]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) of all keys of each fingerprint."""
    rows, keys = [], []
    x = fps.astype(np.uint64)
    seg = [((x >> np.uint64(lo)) & np.uint64((1 << w) - 1)).astype(np.int64) for lo, w in SEGMENTS]
    for i, exact in enumerate(seg):
        near, width = seg[(i + 1) % 3], SEGMENTS[(i + 1) % 3][1]
        flips = np.concatenate([[0], 1 << np.arange(width)])
        index = np.sort(golay_index((near[:, None] ^ flips[None, :]).ravel()).reshape(len(x), -1), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        at, col = np.nonzero(first)
        rows.append(at)
        keys.append((np.int64(i) << 40) | (exact[at] << 12) | index[at, col])
    return np.concatenate(rows), np.concatenate(keys)


def _with_keys(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(i, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                at, key = golay_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], names=["key", "fp"])

    return map_batches(fps.select("fp"), run, [("key", "long"), ("fp", "long")])


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) with the same components as all pairs of distinct
    fingerprints (column fp) at most ``max_bits`` (0 to 2) bits apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("Golay keys find fingerprints at most two bits apart")
    keyed = cut_lineage(_with_keys(fps))
    sizes = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    small = keyed.join(sizes.where(F.col("n") <= DIRECT_KEY).select("key"), "key")
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    pairs = (small.select("key", F.col("fp").alias("u")).join(small.select("key", F.col("fp").alias("v")), "key")
             .where((F.col("u") > F.col("v")) & (apart <= max_bits)).select("u", "v"))
    crowded = cut_lineage(keyed.join(sizes.where(F.col("n") > DIRECT_KEY).select("key"), "key").select("fp").distinct())
    return pairs.unionByName(_neighbour_ties(crowded, max_bits)).distinct()


def _neighbour_ties(fps: DataFrame, max_bits: int) -> DataFrame:
    """Fingerprints that meet at a vector between them, tied to the least one.

    Up to two bits apart: at distance one or none from both. One bit apart:
    at the vector with the differing bit set, of which both know the bit."""
    one_bit = [F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)]
    if max_bits == 0:
        return fps.where("false").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    if max_bits == 2:
        ball = fps.select("fp", F.explode(F.array(F.col("fp"), *one_bit)).alias("z")).withColumn("bit", F.lit(0))
    else:
        ball = fps.select("fp", F.posexplode(F.array(*[F.greatest(F.col("fp"), x) for x in one_bit])).alias("bit", "z"))
    least = cut_lineage(ball.groupBy("z", "bit").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1"))
    return ball.join(least, ["z", "bit"]).where("fp <> v").select(F.col("fp").alias("u"), "v")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, fp, component_id, representative) of every row.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the smallest id reachable (null if all are null).
    ``representative`` is true for the rows equal to the component's first by
    (id, row); rows with a null id come last. Null and empty texts have
    fingerprint zero and are linked like any other; repeated rows share their
    component; an empty table gives an empty result; other columns are not
    read.
    """
    rows = cut_lineage(simhash(docs, shingle, seed, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first")
    by_fp = cut_lineage(rows.groupBy("fp").agg(first))
    roots = connected_components(fingerprint_links(by_fp, max_bits))
    member = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    best = member.groupBy("root").agg(F.min("first").alias("best"))
    of_fp = cut_lineage(member.join(cut_lineage(best), "root").select("fp", "best"))
    return rows.join(of_fp, "fp").select(
        "doc_id", "row", "fp", F.col("best.id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("row") == F.col("best.row"))).alias("representative"))


def keep_representatives(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` (columns doc_id and text among them) without all
    but one row of each near-duplicate group. Columns stay as they are."""
    kept = near_duplicates(docs, shingle, max_bits, seed).where("representative").select(
        F.col("doc_id").alias("_kept_id"), F.col("row").alias("_kept_row")).distinct()
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id"), F.col("text").cast("string")))
    found = keyed.join(kept, (keyed["_row"] == kept["_kept_row"]) & keyed["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
    # Rows equal in id and text are repeats of one document: one of them stays.
    return found.dropDuplicates(["_row", "doc_id"]).select(*docs.columns)


def fingerprint_hex() -> F.Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))


def simhash_classes(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): ``near_duplicates`` with the
    fingerprint as 16 lowercase hexadecimal digits."""
    return near_duplicates(docs, shingle, max_bits, seed, id_col, text_col).select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")
