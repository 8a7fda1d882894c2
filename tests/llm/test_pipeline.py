"""The pipeline's stages against brute force and planted rows."""

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sitequill.llm import language_id, pu_quality

from .test_dedup import fingerprint_by_brute_force, removed_by_brute_force, roots_by_brute_force
from .test_tokens import BYTE, _check_packing

SF = "/root/testdata/sf0.001"


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "simhash_near_dedup", "substring_dedup", "packing"]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    langs = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs, pieces), pieces).collect()}
    rows = [(d, t) for d, t in rows if langs[d].lang_pred != "und" and langs[d].score >= 0.5]
    kept = {d for d, _ in rows}
    left = docs.where(docs.doc_id.isin(list(kept)))
    model = pu_quality.train(left, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in pu_quality.score_documents(left, model).collect() if r.predicted}
    rows = [(d, t) for d, t in rows if d in good]
    groups = defaultdict(list)
    for (d, _), root in zip(rows, roots_by_brute_force([fingerprint_by_brute_force(t) for _, t in rows], 2), strict=True):
        groups[root].append(d)
    first = {min(g) for g in groups.values()}
    rows = sorted((d, t) for d, t in rows if d in first)
    texts = []
    for (d, t), (_, n, gone, _) in zip(rows, removed_by_brute_force(rows, 35), strict=True):
        if gone:
            t = " ".join(_kept(rows, d, t))
        texts.append((d, t))
    pieces_out = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces_out} == first
    _check_packing(texts, pieces_out, Tokenizer.from_file(BYTE), most_padding=0.03)


def _kept(rows, doc_id, text):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    if not hasattr(_kept, "seen") or _kept.rows is not rows:
        seen = Counter()
        for w in words.values():
            seen.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
        _kept.seen, _kept.rows = seen, rows
    w = words[doc_id]
    gone = {q for p in range(len(w) - 34) if _kept.seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
    return [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_of_odd_and_empty_tables(spark, make_docs, odd_rows, stage):
    _, run = corpus_pipeline.STAGES[stage]
    for docs in (make_docs(odd_rows, clashing=True), make_docs([])):
        out = run(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.dtypes == docs.dtypes
        out.collect()


def test_packing_stage_of_odd_and_empty_tables(spark, make_docs, odd_rows):
    _, run = corpus_pipeline.STAGES[4]
    assert sum(p.length for p in run(spark, make_docs(odd_rows), SF).collect()) > len(odd_rows)
    assert run(spark, make_docs([]), SF).count() == 0


def test_substring_stage_updates_texts_and_lengths(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([(1, "keep this " + long), (2, long), (3, " spaced   out "), (4, None)])
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.remove_repeated_passages(spark, docs, SF).collect()}
    assert out == {1: ("keep this", 9), 2: ("", 0), 3: (" spaced   out ", 14), 4: (None, None)}
