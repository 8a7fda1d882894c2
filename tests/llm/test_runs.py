"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitequill.llm import queries, runs

SF = "/root/testdata/sf0.001"


def runs_by_brute_force(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def digests_by_brute_force(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_brute_force(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found_in(texts):
    """Runs by text; a text is a sequence of small numbers."""
    first = np.cumsum([0, *map(len, texts)])
    codes = (np.array([w for t in texts for w in t], np.uint64) + np.uint64(1)) * np.uint64(2654435761) | np.uint64(1)
    got = runs.find_runs(codes, first)
    owner = np.searchsorted(first, got[:, 0], side="right") - 1
    return [[(s - int(first[i]), n, p) for s, n, p in got[owner == i].tolist()] for i in range(len(texts))]


@st.composite
def periodic(draw):
    letters = draw(st.integers(1, 4))
    out = []
    for _ in range(draw(st.integers(0, 5))):
        piece = draw(st.lists(st.integers(0, letters), min_size=1, max_size=8))
        out += piece * draw(st.integers(1, 9))
        out = out[: len(out) - draw(st.integers(0, 3))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic(), max_size=6))
def test_runs_of_generated_sequences(texts):
    assert found_in(texts) == [runs_by_brute_force(t) for t in texts]


def test_runs_inside_runs_and_at_both_ends():
    texts = [[0] * 6, [0] * 5, [1, *([0] * 7), 2], ([0] * 6 + [1]) * 5, [0, 1] * 3, [0, 1] * 4, [3, *([0, 1, 2] * 4), 0, 1], [], [5] * 400, ([1, 2] * 5 + [3]) * 30]
    assert found_in(texts) == [runs_by_brute_force(t) for t in texts]


def test_pairs_are_found_through_either_lookup():
    """Many places with many left words, and many places with one."""
    rng = random.Random(2)
    many = [x for _ in range(60) for x in (100 + rng.randint(0, 40), *([1] * rng.randint(5, 30)))]
    assert found_in([many]) == [runs_by_brute_force(many)]


@pytest.mark.parametrize("n,period", [(30_000, 1), (30_000, 11), (40_000, 10_000)])
def test_long_runs_take_bounded_work(n, period):
    text = [7, *(list(range(10, 10 + period)) * (n // period))]
    assert found_in([text]) == [[(1, n // period * period, period)]]


def test_digests_of_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (30, "a b " * 9 + "c"), (31, "x\n" * 50), (32, "é " * 6)]
    got = runs.run_digests(make_docs(rows, clashing=True), plant=True).collect()
    assert Counter(map(tuple, got)) == Counter(digests_by_brute_force(*r) for r in rows)
    plain = runs.run_digests(make_docs(rows)).collect()
    assert Counter(map(tuple, plain)) == Counter(digests_by_brute_force(*r, plant=False) for r in rows)


def test_planted_texts(make_docs):
    rng = random.Random(4)
    ids = [d for d in range(4000) if zlib.crc32(str(d).encode()) % 10 == 0][:150]
    rows = [(d, " ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 120)))) for d in ids]
    got = runs.run_digests(make_docs(rows), plant=True).collect()
    assert Counter(map(tuple, got)) == Counter(digests_by_brute_force(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 30


def test_runs_and_collapsed_texts(make_docs):
    got = {r.doc_id: r for r in runs.periodic_runs(make_docs([(1, "say  no no no no no no more"), (2, None), (3, "plain  text"), (None, "")])).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 6, 1)] and got[1].collapsed == "say no more"
    assert got[2].runs == [] and got[2].collapsed == "" and got[3].collapsed == "plain text" and got[None].collapsed == ""


def test_empty_table(make_docs):
    assert runs.run_digests(make_docs([])).collect() == [] and runs.periodic_runs(make_docs([])).collect() == []


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(digests_by_brute_force(*r) for r in rows)
