"""Multi-index hashing search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitequill.llm import queries, vector_search
from sitequill.llm.vector_search import BITS, TABLES, learn, search, usable_vectors

SF = "/root/testdata/sf0.01"
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)


def by_brute_force(rows, wanted, k=10):
    """rank list of (id, distance) for each query id; ids unique."""
    out = {}
    for q in wanted:
        x = np.array(rows[q], np.float64)
        near = sorted((float(np.sqrt(((np.array(v, np.float64) - x) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = near[:k]
    return out


def recall(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, near in want.items():
        own = sorted(mine.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(near) + 1))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert len({r.vec_id for r in own}) == len(own) and q not in {r.vec_id for r in own}
        hits += len({r.vec_id for r in own} & {i for _, i in near})
        total += len(near)
    return hits / max(total, 1)


def test_query_against_brute_force(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = queries.QUERIES["op11_vector_search"](spark, SF).collect()
    assert [f"{n}:{t}" for n, t in queries.QUERIES["op11_vector_search"](spark, SF).dtypes] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"]
    want = by_brute_force(rows, [i for i in rows if i % 100 == 0])
    assert recall(got, want) >= 0.95
    exact = {(q, i): d for q, near in by_brute_force(rows, want, len(rows)).items() for d, i in near}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got)


def test_recall_with_a_sample_smaller_than_the_table(spark, table):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24)) * 2
    rows = {i: (centres[i % 20] + rng.normal(size=24)).tolist() for i in range(4000)}
    vectors = table(rows.items())
    model = learn(usable_vectors(vectors), sample_rows=500, nearest=200)
    assert model.sample.shape == (500, TABLES) and model.rank == 25
    got = search(vectors, vectors.where("vec_id % 100 = 0"), model=model).collect()
    want = by_brute_force({i: np.array(v, np.float32) for i, v in rows.items()}, range(0, 4000, 100))
    assert recall(got, want) >= 0.9


def test_probing_finds_every_code_within_the_radius(spark, table, monkeypatch):
    """Small buckets and blocks; candidates equal all pairs of codes."""
    for name, value in (("INDEX_BLOCK", 16), ("QUERY_BLOCK", 5), ("HELD_ENTRIES", 300)):
        monkeypatch.setattr(vector_search, name, value)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(250, 16)), np.repeat(rng.normal(size=(1, 16)), 150, axis=0) + rng.normal(size=(150, 16)) * 0.05])
    vectors = usable_vectors(table([(i, v) for i, v in enumerate(x.tolist())]))
    model = learn(vectors, sample_rows=100, nearest=30)._replace(rank=8)
    assert model.bucket_bits >= 4
    wanted = vectors.where("vec_id % 9 = 0")
    found = vector_search.candidates(vector_search.index_blocks(vectors, model), vector_search.query_blocks(wanted, model))
    got = sorted((r.query_id, r.vec_id) for r in found.collect())
    code = model.codes(np.array([r.vec for r in vectors.orderBy("vec_id").collect()]))
    radius = vector_search._radii(model, code)
    want = [(q, v) for q in range(0, 400, 9) for v in range(400) if v != q and np.bitwise_count(code[q] ^ code[v]).sum() <= radius[q]]
    assert got == sorted(want)  # each once, by one table


def test_odd_vectors_take_no_part(table):
    good = {i: [float(i), 1.0, float(i % 7)] for i in range(30)}
    odd = [(100, None), (200, []), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]),
           (600, [float("inf"), 1.0, 1.0]), (700, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    vectors = table([*good.items(), *odd]).select("*", *[F.lit(1).alias(c) for c in ("vec", "query_id", "rank", "score", "t", "bucket")])
    got = search(vectors, vectors.where("vec_id % 100 = 0 OR vec_id IS NULL")).collect()
    assert {r.query_id for r in got} == {0}
    assert recall(got, by_brute_force(good, [0])) == 1.0


def test_ties_repeats_and_few_rows(table):
    """Equal vectors: the smaller ids first; a repeated row counts once."""
    rows = [(i, [1.0, 2.0]) for i in range(25)] + [(7, [1.0, 2.0])] + [(50, [5.0, 5.0]), (50, [1.0, 2.5])]
    got = search(table(rows), table([(20, [1.0, 2.0]), (20, [1.0, 2.0])])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(20, i + 1, i, 0.0) for i in range(10)]
    few = search(table([(0, [1.0]), (1, [3.0]), (2, [2.0])]), table([(0, [1.0])])).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 2, 1.0), (2, 1, 2.0)]


def test_no_vectors(table):
    assert search(table([]), table([])).collect() == []
    assert search(table([(1, None)]), table([(1, None)])).collect() == []
    assert search(table([(100, [1.0])]), table([(100, [1.0])])).collect() == []


def test_vectors_longer_than_the_code(table):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=BITS + 40).astype(np.float32).tolist() for i in range(60)}
    got = search(table(rows.items()), table([(0, rows[0])])).collect()
    assert recall(got, by_brute_force(rows, [0])) >= 0.9
