"""Reading and mapping helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..sources.tables import read_table

__all__ = ["cut_lineage", "documents", "id_text", "fold_remainder", "row_key", "map_texts", "map_batches"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` and ``text``;
    other columns, whatever their names, never meet the operator's own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold_remainder(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def row_key() -> Column:
    """A row's identity where ids may be null or repeated: rows that agree in
    both id and text are copies of each other in every respect that counts."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[tuple[str, T.DataType | str]]) -> DataFrame:
    """``mapInArrow`` with a schema given as (name, type) pairs."""
    schema = T.StructType()
    for name, kind in fields:
        schema = schema.add(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType if isinstance(kind, str) else kind)
    return df.mapInArrow(fn, schema)


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict], fields: list[tuple[str, T.DataType | str]], limit: int | None = None) -> DataFrame:
    """(doc_id, text) rows to (doc_id, fields of ``fn``) rows, chunk by chunk.

    ``fn`` gets the texts of a bounded chunk (null as empty) and returns one
    sequence per field."""
    kind = df.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .ragged import CHUNK_CHARS, batch_chunks

        for batch in batches:
            for part, texts in batch_chunks(batch, "text", limit or CHUNK_CHARS):
                made = fn(texts)
                arrays = [part.column("doc_id"), *(a if isinstance(a, pa.Array) else pa.array(a) for a in made.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *made])

    return map_batches(df.select("doc_id", "text"), run, [("doc_id", kind), *fields])
