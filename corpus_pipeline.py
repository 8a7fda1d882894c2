"""Corpus pipeline: from raw documents to packed training sequences.

Stages, in order: language identification (documents without a determined
language go), quality classifier (documents it rejects go), SimHash near-dedup
(one document of each group stays), substring dedup (repeated passages leave
the texts) and packing. Each stage takes (spark, docs, sf_dir) and works on
all that its predecessor kept; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet to the shared
checkpoint folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequill.llm import language_id, packing, pu_quality, simhash, substring_dedup
from sitequill.llm.common import cut_lineage, documents
from sitequill.sources.tables import read_table

#: Least posterior of a determined language.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined. Null and letterless texts go, and
    so does what no learned language explains better than a background of equal
    pieces does: noise, and other languages. Repeated rows are judged alike, an
    empty table stays empty, very long texts are read whole."""
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    return language_id.keep_identified(docs, language_id.train(docs, pieces), pieces, LEAST_LANGUAGE_SCORE)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from these documents and their
    labels, scores at its threshold or above. Null and empty texts have no
    words and score as such; repeated rows score alike; with an empty table
    nothing is learned and nothing returned. Texts are read whole."""
    return pu_quality.keep_good(docs, pu_quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group. Null
    and empty texts are near-duplicates of each other; of repeated rows one
    stays; a null id comes after all others; an empty table stays empty. Very
    long texts enter whole."""
    return simhash.keep_representatives(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document; words in repeated windows leave its text, whose length
    n_chars follows. A text made of repeats alone becomes empty."""
    carried = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    named = docs.select(F.col("text"), *[F.col(c).alias(a) for c, a in carried.items()])
    out = substring_dedup.remove_repeated_windows(named, id_col=carried["doc_id"], carried=list(carried.values()))
    columns = {c: F.col(a) for c, a in carried.items()} | {"text": F.col("text")}
    if "n_chars" in carried:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col(carried["n_chars"]))
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences. Null and empty texts are
    one end token; repeated rows are packed each; an empty table gives no piece;
    a text longer than a sequence is cut over several."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack),
]

#: SQL can express neither the learned stages nor the tokenizer; the rows are
#: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
