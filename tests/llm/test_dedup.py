"""Substring dedup and SimHash near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sitequill.llm import queries, simhash
from sitequill.llm.components import connected_components
from sitequill.llm.simhash import fingerprint_links, golay_index, golay_keys, keep_representatives, near_duplicates, simhash_classes
from sitequill.llm.substring_dedup import COVERS, difference_cover, remove_repeated_windows

SF = "/root/testdata/sf0.001"


def removed_by_brute_force(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = defaultdict(list)
    for i, w in enumerate(words):
        for p in range(len(w) - window + 1):
            places[tuple(w[p : p + window])].append((i, p))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                gone[i] |= set(range(p, p + window))
    return [(d, len(w), len(g), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in g).encode()).hexdigest())
            for (d, _), w, g in zip(rows, words, gone, strict=True)]


@pytest.mark.parametrize("period", [3, 7, 10, 13, 21, 31])
def test_difference_covers(period):
    cover = set(difference_cover(period).tolist())
    for shift in range(period):
        assert any((c + shift) % period in cover for c in cover)
    if period in COVERS:
        assert len(cover) * (len(cover) - 1) == period - 1


def test_removal_of_odd_rows(make_docs, odd_rows):
    got = remove_repeated_windows(make_docs(odd_rows, clashing=True), digest=True).collect()
    assert Counter(map(tuple, got)) == Counter(removed_by_brute_force(odd_rows, 35))


@pytest.mark.parametrize("seed", range(2))
def test_removal_with_shared_passages(make_docs, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passages = [[f"p{rng.randint(0, 9999)}" for _ in range(n)] for n in (12, 13, 20, 60, 120)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() + str(rng.randint(0, 50)) for _ in range(rng.randint(0, 40))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            words += p[a : rng.randint(a, len(p))]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (5, rows[5][1])]
    got = remove_repeated_windows(make_docs(rows), window=13, period=7, digest=True).collect()
    assert Counter(map(tuple, got)) == Counter(removed_by_brute_force(rows, 13))


def test_thue_morse_words_are_not_taken_for_each_other(make_docs):
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(d, " ".join([f"w{i}" for i in range(20)] + [word] + [f"w{i}" for i in range(20, 34)])) for d, word in ((1, one), (2, other))]
    assert [r.n_removed for r in remove_repeated_windows(make_docs(rows), digest=True).collect()] == [0, 0]


def test_many_copies_of_one_row_leave_one_list_of_its_places(make_docs, spark, monkeypatch):
    """Equal rows, with an id and without: what a row carries is bounded by its own words."""
    from sitequill.llm import substring_dedup

    lists = []
    kept = substring_dedup.cut_lineage

    def spy(df):
        out = kept(df)
        if "places" in out.columns:
            lists.append(max((len(r.places or []) for r in out.collect()), default=0))
        return out

    monkeypatch.setattr(substring_dedup, "cut_lineage", spy)
    text = " ".join(f"w{i % 200}" for i in range(300))
    rows = [(7, text)] * 60 + [(None, text)] * 60 + [(8, "alone " + text)]
    got = remove_repeated_windows(make_docs(rows), digest=True).collect()
    assert Counter(map(tuple, got)) == Counter(removed_by_brute_force(rows, 35))
    assert lists and max(lists) <= 301


def test_removal_returns_texts_and_carried_columns(make_docs):
    long = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(1, "before  it " + long), (2, long + "\nafter it"), (3, "  left   alone "), (4, None)])
    got = {r.doc_id: r for r in remove_repeated_windows(docs, carried=["doc_id", "lang"]).collect()}
    assert {d: r.text for d, r in got.items()} == {1: "before it", 2: "after it", 3: "  left   alone ", 4: None}
    assert got[1].lang == "en" and got[1].n_removed == 40 and got[3].n_removed == 0


def test_removal_query_and_empty_table(spark, make_docs):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op1_substring_dedup"](spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(removed_by_brute_force(rows, 35))
    assert remove_repeated_windows(make_docs([]), digest=True).count() == 0


def fingerprint_by_brute_force(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", lowered)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_brute_force(values, bits):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def classes_by_brute_force(rows):
    fps = [fingerprint_by_brute_force(t) for _, t in rows]
    roots = roots_by_brute_force(fps, 2)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return Counter((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots, strict=True))


def test_golay_decoding_is_perfect():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 2000)
    index = golay_index(x)
    # Words up to three bits from a codeword decode to it.
    for flips in ([], [3], [0, 22], [1, 9, 17]):
        y = np.array([i << 11 for i in range(4096)])
        from sitequill.llm.simhash import _syndrome

        code = y ^ _syndrome(y)
        for f in flips:
            code = code ^ (1 << f)
        assert (golay_index(code) == np.arange(4096)).all()
    assert index.min() >= 0 and index.max() < 4096


def test_keys_meet_within_two_bits():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        at, key = golay_keys(np.array([a, b], np.uint64))
        assert set(key[at == 0].tolist()) & set(key[at == 1].tolist())


@pytest.mark.parametrize("bits,direct", [(0, 1), (1, 1), (2, 64), (2, 2)])
def test_links_with_and_without_crowded_keys(spark, monkeypatch, bits, direct):
    monkeypatch.setattr(simhash, "DIRECT_KEY", direct)
    rng = random.Random(bits)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for b in rng.sample(range(64), rng.randint(1, 2)):
                v ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits)
    root = {r.node: r.root for r in connected_components(links).collect()}
    want = roots_by_brute_force(values, bits)
    groups = defaultdict(set)
    for s, w in zip(signed, want, strict=True):
        groups[w].add(s)
    for g in groups.values():
        assert {root.get(s, s) for s in g} == {min(g)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(7, 7), (700, 699)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 500 for i in range(500, 560)}, 699: 699, 700: 699}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_classes_of_odd_rows(make_docs, odd_rows):
    got = simhash_classes(make_docs(odd_rows, clashing=True)).collect()
    assert Counter(map(tuple, got)) == classes_by_brute_force(odd_rows)
    assert simhash_classes(make_docs([])).count() == 0


def test_class_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op7_simhash"](spark, SF).collect()
    assert Counter(map(tuple, got)) == classes_by_brute_force(rows)


def test_one_row_of_each_group_stays(make_docs, odd_rows):
    docs = make_docs(odd_rows, clashing=True)
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    roots = roots_by_brute_force([fingerprint_by_brute_force(t) for _, t in odd_rows], 2)
    ids = defaultdict(list)
    for (d, _), r in zip(odd_rows, roots, strict=True):
        ids[r].append(d)
    least = [min((d for d in x if d is not None), default=None) for x in ids.values()]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least)
    assert Counter(r.doc_id for r in near_duplicates(docs).where("representative").dropDuplicates().collect()) == Counter(least)
