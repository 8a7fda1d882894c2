"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side inside no token of the
vocabulary can never be merged, so they mark a certain cut. Pre-token ends
are such cuts too. The fragments between cuts are encoded on their own (equal
ones once per chunk, unseen ones together as ragged arrays) and their ids are
concatenated. One narrow pass over the scan, no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_texts


def _encoder(path: str):
    from .bpe import encoder

    return encoder(path, spaced=False, fold=True, forced_cuts=True, keep_text=True)


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row.

    ``ids`` and ``decoded`` are what the library's encode and decode give.
    Null text: empty, so no ids and an empty decoded text. Repeated rows and
    null ids are encoded like any other row; an empty table gives an empty
    result; other columns are not read.
    """

    def run(texts: list[str]) -> dict:
        import pyarrow as pa

        enc = _encoder(vocabulary_path)
        entry, offsets, ids, ends = _encoded(enc, texts)
        flat = pa.array(ids.astype("int32"))
        return {"ids": pa.ListArray.from_arrays(pa.array(ends.astype("int32")), flat), "decoded": _decoded(enc, entry, offsets)}

    return map_texts(id_text(docs, id_col, text_col), run, [("ids", "array<int>"), ("decoded", "string")])


def encode_decode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode_decode`` with
    the digests taken where the ids are, so that ids never leave the task.

    Nulls, repeats, empty tables and other columns as in ``encode_decode``.
    """

    def run(texts: list[str]) -> dict:
        enc = _encoder(vocabulary_path)
        entry, offsets, ids, ends = _encoded(enc, texts)
        raw = memoryview(ids.astype("<u4").tobytes())
        bounds = ends.tolist()
        return {
            "n_tokens": ends[1:] - ends[:-1],
            "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in _decoded(enc, entry, offsets)],
        }

    out = map_texts(id_text(docs, id_col, text_col), run, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")


def _encoded(enc, texts):
    """Cache entries and offsets by text, ids and offsets by text."""
    import numpy as np

    from .ragged import ragged_index

    entry, offsets = enc.entries(texts)
    length = enc.length[entry]
    ids = enc.ids[ragged_index(enc.start[entry], length)]
    ends = np.zeros(len(entry) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    return entry, offsets, ids, ends[offsets]


def _decoded(enc, entry, offsets) -> list[str]:
    """The library's decoding without a decoder: token strings, space-joined."""
    words = enc.decoded
    out, listed, bounds = [], entry.tolist(), offsets.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        out.append(" ".join([words[i] for i in listed[a:b]]))
    return out
