"""Merkle manifest against a tree built by hand."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sitequill.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, i):
    path = []
    for level in levels[:-1]:
        run, slot = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        i //= 8
    return path


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        own = sorted(((r[0] is not None, r[0] or 0, digest("".join(map(encoded, r))), r) for r in groups[name]), key=lambda x: x[:3])
        trees.append((own, levels_of([x[2] for x in own])))
    upper = levels_of([levels[-1][0] for _, levels in trees])
    out = []
    for j, (own, levels) in enumerate(trees):
        for i, (_, _, leaf, r) in enumerate(own):
            path = path_of(levels, i) + path_of(upper, j)
            folded = leaf
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[4] is not None:
                folded = digest("".join(map(encoded, (*r[:4], r[4].translate(str.maketrans(merkle.UPPER, merkle.LOWER))))))
            for before, after in path:
                folded = digest(before + folded + after)
            out.append((r[0], leaf, levels[-1][0], upper[-1][0], digest("".join(b + a for b, a in path)), folded, folded == upper[-1][0]))
    return out


def table(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_proofs_of_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (20, "Ä é MIXED Case", "ä"), (21, "lower only", "z"), (22, "no language", None), (22, "no language", None), (23, "x", "")]
    docs = make_docs(rows, clashing=True).select("*", *[F.lit(1).alias(c) for c in ("g", "pos", "n", "digest", "path", "pid", "top", "before", "level0")])
    got = merkle.document_proofs(docs).collect()
    assert Counter(map(tuple, got)) == Counter(by_hand(table(docs)))


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [64, 65, 3], [700], [1] * 20, [513, 2, 73]])
def test_proofs_by_size_of_the_groups(make_docs, sizes):
    """Last runs of one, several rounds, many groups; blocks of 64 leaves."""
    rows = [(100 * j + 7 * i, f"Text {i} of {j}", f"l{j}") for j, n in enumerate(sizes) for i in range(n)]
    docs = make_docs(rows).repartition(5)
    got = merkle.document_proofs(docs, levels=2).collect()
    assert Counter(map(tuple, got)) == Counter(by_hand(table(docs)))


def test_hot_group_of_equal_rows(make_docs):
    docs = make_docs([(1, "same", "en")] * 600 + [(2, "Other", "de")])
    assert Counter(map(tuple, merkle.document_proofs(docs).collect())) == Counter(by_hand(table(docs)))


def test_only_changed_texts_fail(make_docs):
    docs = make_docs([(i, "Upper" if i % 2 else "lower") for i in range(90)])
    for r in merkle.document_proofs(docs).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or r.doc_id % 2 == 0)


def test_empty_table(make_docs):
    assert merkle.document_proofs(make_docs([])).collect() == []


def test_query_equals_its_sql_and_the_hand_made_tree(spark):
    got = queries.QUERIES["op12_merkle_manifest"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rows = con.execute(queries.ORACLES["op12_merkle_manifest"])
    assert [c[0] for c in rows.description] == got.columns
    mine = Counter(map(tuple, got.collect()))
    assert mine == Counter(rows.fetchall()) == Counter(by_hand(table(spark.read.parquet(f"{SF}/documents.parquet"))))


def test_no_window_over_a_whole_group_and_no_cross_join(spark):
    plan = queries.QUERIES["op12_merkle_manifest"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan
