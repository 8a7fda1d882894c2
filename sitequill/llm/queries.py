"""Registered queries of the training-data operators, with production
parameters over the whole tables, and their DuckDB twins where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import merkle, pu_quality, quality_rules, vector_search
from .bpe_codec import encode_decode_digests
from ..sources.tables import read_table
from .common import documents
from .fingerprints import EDITED_SQL, edited_fingerprints
from .language_id import predict, train
from .license_scan import scan_licenses
from .packing import pack_documents
from .runs import run_digests
from .simhash import simhash_classes
from .substring_dedup import remove_repeated_windows
from .token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     s AS (SELECT doc_id, unnest(range(len(ws) - 34)) AS p, ws FROM w WHERE len(ws) >= 35),
     g AS (SELECT doc_id, p, md5(array_to_string(ws[p + 1 : p + 35], ' ')) AS h FROM s),
     r AS (SELECT doc_id, p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
     c AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM r) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(coalesce(k.kept, CASE WHEN gone IS NULL THEN ws ELSE [] END), ' ')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id
LEFT JOIN (SELECT t.doc_id, list(t.x ORDER BY t.i) AS kept
           FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w) t
           JOIN c ON t.doc_id = c.doc_id
           LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM c) o ON t.doc_id = o.doc_id AND t.i = o.i
           WHERE o.i IS NULL GROUP BY t.doc_id) k ON w.doc_id = k.doc_id
"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir), digest=True)


@query("op2_bpe_codec")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


query("op3_quality_rules", quality_rules.SQL)(quality_rules.query)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces = documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    return predict(docs, train(docs, pieces), pieces)


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pu_quality.score_documents(docs, pu_quality.train(docs, read_table(spark, sf_dir, "labels")))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(documents(spark, sf_dir))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_document_fingerprints", EDITED_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


@query("op11_vector_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return vector_search.search(vectors, vectors.where("vec_id % 100 = 0"))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_proofs(documents(spark, sf_dir))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(documents(spark, sf_dir), plant=True)
