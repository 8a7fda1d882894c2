"""Language ID, quality rules and classifier, license scan, sketches."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sitequill.llm import fingerprints, language_id, license_scan, pu_quality, quality_rules, queries

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def oracle(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same_as_oracle(df, sql, rows):
    names, want = oracle(sql, rows)
    assert sorted(df.columns) == sorted(names)

    def plain(x):
        return round(x, 9) if isinstance(x, float) else x

    assert Counter(tuple(plain(x) for x in r) for r in df.select(*names).collect()) == Counter(tuple(plain(x) for x in r) for r in want)


# Language ID


@pytest.fixture(scope="module")
def lattice():
    return language_id.Lattice(PIECES)


def all_segmentations(word, ids, p, longest):
    """Probability of every segmentation, by recursion."""
    if not word:
        return [((), 1.0)]
    out = []
    for n in range(1, min(longest, len(word)) + 1):
        head = word[:n]
        if head in ids:
            q, own = p[ids[head]], (ids[head],)
        elif n == 1:
            q, own = language_id.UNKNOWN, ()
        else:
            continue
        out += [(own + rest, q * r) for rest, r in all_segmentations(word[n:], ids, p, longest)]
    return out


def test_forward_sums_all_segmentations(lattice):
    rng = np.random.default_rng(0)
    model = rng.random((lattice.size, 2))
    model /= model.sum(axis=0)
    ids = {p: i for i, p in enumerate(language_id.pieces(PIECES))}
    words = ["the", "ünder", "a", "漢字ab", "straße", "nation"]
    big, s, e, _, _ = language_id._words([" ".join(words), "", "12 !"])
    scores = language_id.word_scores(big, s, e, lattice, model)
    counts = language_id.expected_counts(big, s, e, np.ones(len(s)), lattice, model[:, 0].copy())
    want = np.zeros(lattice.size)
    for i, w in enumerate(words):
        for lang in (0, 1):
            total = sum(q for _, q in all_segmentations(language_id.MARK + w, ids, model[:, lang], lattice.longest))
            assert abs(scores[i, lang] - np.log(total)) < 1e-9
        every = all_segmentations(language_id.MARK + w, ids, model[:, 0], lattice.longest)
        total = sum(q for _, q in every)
        for own, q in every:
            for piece in own:
                want[piece] += q / total
    assert np.abs(counts - want).max() < 1e-9


def test_long_words_are_rescaled(lattice):
    model = np.full(lattice.size, 1 / lattice.size)
    long = "thenation" * 40
    big, s, e, _, _ = language_id._words([long + " 漢" * 3])
    scores = language_id.word_scores(big, s, e, lattice, model[:, None])
    assert np.isfinite(scores).all() and scores[0, 0] < -400
    counts = language_id.expected_counts(big, s, e, np.ones(len(s)), lattice, model)
    sizes = np.array([len(p) for p in language_id.pieces(PIECES)])
    # The expected pieces cover every covered character once.
    ids = {p for p in language_id.pieces(PIECES)}
    covered = sum(c in ids for c in long) + 1 + 3 * (1 + ("漢" in ids))
    assert abs((counts * sizes).sum() - covered) < 1e-6


def test_language_of_held_out_rows(spark):
    df = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01")
    rows = df.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(make_docs, odd_rows, spark):
    training = [(100 + i, f"the house and the tree number {i}", "en") for i in range(20)] + [(200 + i, f"das haus und der baum nummer {i}", "de") for i in range(20)]
    model = language_id.train(make_docs([*training, (300, "unlabelled", None)]), PIECES)
    assert model.langs == ["de", "en"]
    rows = [*odd_rows, (900, "12 345 !"), (901, "der baum und das haus"), (902, "the tree and the house " * 2000)]
    got = language_id.predict(make_docs(rows, clashing=True), model, PIECES).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[d].lang_pred for d in (1, 2, 3, 900, 901, 902)] == ["und", "und", "und", "und", "de", "en"]
    assert by_id[1].score == 0 and by_id[901].score > 0.9
    docs = make_docs(rows, clashing=True)
    kept = language_id.keep_identified(docs, model, PIECES)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {901, 902} and kept.where("doc_id IN (1, 2, 3, 900)").count() == 0
    assert language_id.predict(make_docs([]), model, PIECES).count() == 0


def test_noise_and_unlearned_languages_go(spark, make_docs):
    """Posteriors near 1, but no gain over the background; clean rows stay."""
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (5, 60, 2000)]
    other = ["Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.",
             "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "漢字漢字漢字", "Все люди рождаются свободными"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, PIECES)
    planted = make_docs([(-1 - i, t, None) for i, t in enumerate([*noise, *other])])
    scored = language_id.predict(planted, model, PIECES).collect()
    assert min(r.score for r in scored) > 0.5  # the posterior alone would keep them all
    kept = language_id.keep_identified(docs.unionByName(planted), model, PIECES)
    gone = {r.doc_id for r in docs.unionByName(planted).select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()}
    letterless = {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert gone == {r.doc_id for r in planted.collect()} | letterless
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes


def test_no_language_learned(make_docs):
    model = language_id.train(make_docs([]), PIECES)
    got = language_id.predict(make_docs([(1, "some text"), (2, None)]), model, PIECES).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


# Quality rules


def test_rules_of_odd_rows(make_docs, odd_rows):
    rng = random.Random(0)
    rows = [*odd_rows, (20, "the word and the other word are here in one line of text\n" * 40), (21, "a b c d e f a b c d e g h i j"), (22, "# * $ % & | < > a b c d"), (23, "!!! " * 60)]
    rows += [(30 + i, " ".join(rng.choice(["the", "a", "und", "x#", "y\n", "zz.", "é"]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    df = quality_rules.quality_rules(make_docs(rows, clashing=True))
    # The oracle groups by id, and copies a text's words for each of its windows.
    unique = list({r[0]: r for r in rows if r[0] is not None and len(r[1] or "") < 5000}.values())
    same = quality_rules.quality_rules(make_docs(unique)).drop("failed", "n_stop_words", "n_exclamations", "n_lines")
    same_as_oracle(same, quality_rules.SQL, unique)
    assert df.count() == len(rows)
    assert df.where("doc_id = 20").first().base_failed and not df.where("doc_id = 1").first().kept
    assert df.where("doc_id = 23").first().failed


def test_rule_query_and_empty_table(spark, make_docs):
    assert quality_rules.quality_rules(make_docs([])).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same_as_oracle(queries.QUERIES["op3_quality_rules"](spark, SF), queries.ORACLES["op3_quality_rules"], rows)


# Quality classifier


def test_positive_unlabelled_learning_recovers_the_prior():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, pu_quality.N_FEATURES))
    x[:, pu_quality.N_WORDS] = 1000
    good = rng.random(6000) < 0.7
    x[~good, 0] += 5
    positive, unlabelled = x[:3000][good[:3000]], x[3000:]
    model = pu_quality.fit(positive, unlabelled)
    assert abs(model.prior - 0.7) < 0.06
    score = model.score(x[3000:])
    assert ((score >= 0.7) == good[3000:]).mean() > 0.97


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.QUERIES["op5_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = df.collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.predicted == int(r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_prior_does_not_turn_on_the_split(spark, sf):
    """Ten seeds of the split: right on held-out labels with each of them."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id", "left").orderBy("doc_id").collect()
    x = pu_quality.features([r.text or "" for r in rows])
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows])
    quality = np.array([-1 if r.quality is None else r.quality for r in rows])
    test = held & (quality >= 0)
    priors = []
    for seed in range(10):
        model = pu_quality.fit(x[~held & (quality == 1)], x[~held], seed=seed)
        priors.append(model.prior)
        assert ((model.score(x[test]) >= 0.7) == (quality[test] == 1)).mean() >= 0.93
    assert max(priors) - min(priors) < 0.06 and abs(np.mean(priors) - (quality[quality >= 0] == 1).mean()) < 0.05


@pytest.mark.parametrize("prior", [0.3, 0.7])
def test_risk_and_gradient_by_brute_force(prior):
    rng = np.random.default_rng(4)
    p, u, w = rng.normal(0.5, 1, (40, 5)), rng.normal(0, 1, (60, 5)), rng.normal(0, 0.3, 5)
    loss = lambda z: math.log(1 + math.exp(-z))

    def by_hand(w):
        z = lambda rows: [sum(a * b for a, b in zip(r, w, strict=True)) for r in rows.tolist()]
        mean = lambda v: sum(v) / len(v)
        return prior * mean([loss(x) for x in z(p)]), mean([loss(-x) for x in z(u)]) - prior * mean([loss(-x) for x in z(p)])

    def slope(f):
        return np.array([(f(w + d) - f(w - d)) / 2e-6 for d in np.eye(5) * 1e-6])

    assert np.allclose(pu_quality.risks(w, p, u, prior), by_hand(w))
    assert by_hand(w)[1] > 0
    assert np.allclose(pu_quality.risk_gradient(w, p, u, prior), slope(lambda v: sum(by_hand(v))), atol=1e-6)
    # All positives far on the positive side, all unlabelled on the negative one: the negative part is below zero.
    p, u, w = p + 9, u - 9, np.ones(5)
    assert by_hand(w)[1] < 0
    assert np.allclose(pu_quality.risk_gradient(w, p, u, prior), -slope(lambda v: by_hand(v)[1]), atol=1e-6)


def _thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_thue_morse_words_are_scored_apart(lattice):
    one, other = _thue_morse(2048)
    x = pu_quality.features([f"{one} {other}", f"{one} {one}"])
    assert x[0, pu_quality.N_WORDS + 4] == 0 and x[1, pu_quality.N_WORDS + 4] == 0.5
    _, _, _, keys, _ = language_id._words([one, other])
    assert keys[0] != keys[1]


def test_classifier_on_odd_rows(make_docs, odd_rows, spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (8, 1), (5, 0), (None, 1), (12345, 1)], "doc_id long, quality int")
    docs = make_docs(odd_rows, clashing=True)
    model = pu_quality.train(docs, labels)
    got = pu_quality.score_documents(docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    kept = pu_quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    none = make_docs([])
    unlearned = pu_quality.train(none, labels)
    assert pu_quality.score_documents(none, unlearned).count() == 0
    assert {r.score for r in pu_quality.score_documents(docs, unlearned).collect()} == {0.5}


def test_sample_bounds_rows_of_a_repeated_id(spark, make_docs, monkeypatch):
    rows = [(1, f"word {i} of a hot id") for i in range(300)] + [(i, f"text number {i}") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 40, 2)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(pu_quality, "fit", lambda positive, unlabelled: sizes.append((len(positive), len(unlabelled))))
    pu_quality.train(make_docs(rows), labels, sample_rows=30)
    free = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % pu_quality.FOLDS != pu_quality.HELD_OUT]
    assert 1 in free and sizes == [(sum(i % 2 for i in free), min(30, len(free)))]


def test_features_do_not_depend_on_the_chunk():
    texts = ["", "one two\nthree", "a a a a", "!!! ***", "é 漢 x1", "   "]
    whole = pu_quality.features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(pu_quality.features([t])[0], whole[i])
    assert (whole[0] == 0).all() and (whole[5] == 0).all()


# License scan


def base_by_brute_force(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        own = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def labels_without_prefilter(text):
    words = license_scan._WORD.findall(text.encode().lower().decode())
    joined = " ".join(words)
    found = [license_scan.Match(m.start(), m.end(), s) for s in license_scan.signatures() for m in s.pattern.finditer(joined)]
    kept = [m for m in found if not any(
        o.start <= m.start and m.end <= o.end and (o.signature.priority, o.end - o.start) > (m.signature.priority, m.end - m.start) for o in found)]
    return {m.signature.label for m in kept} | {m.signature.label for m in found if m.signature.base}


LICENSED = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the License)", "All rights reserved. Copyright (c) 2021 X",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1", "License under CC BY-NC 4.0",
    "under the mit license under the MIT license, cc by nc cc by nc", "released under a BSD 3-clause license", "mit dem license", "GPLv2 license", "the apache",
]


def test_scan_of_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, *((50 + i, "x é " * i + t) for i, t in enumerate(LICENSED)), (99, "word " * 30000 + "under the mit license")]
    got = license_scan.scan_licenses(make_docs(rows, clashing=True)).collect()
    want = Counter((d, *base_by_brute_force(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert [by_id[50 + i].labels for i in (0, 1, 3, 4, 5)] == ["mit", "apache-2", "gpl-3", "lgpl-2", "cc-by-nc"]
    assert by_id[1].labels == "" and by_id[1].score == 0.0 and by_id[50].score == 1.0


@pytest.mark.parametrize("text", LICENSED)
def test_prefilter_loses_no_label(text):
    got = set(filter(None, license_scan.detect(text)["labels"].split(",")))
    assert got == labels_without_prefilter(text)


def test_signatures_run_where_their_keywords_are():
    assert len(license_scan.signatures()) > 300
    for text in ("licensed under gplv2", "license available under the mpl 2 0", "subject to the epl 1 license", "odbl license", "gfdl license", "license cc0",
                 "asl 2 0 license", "license released under busl 1 1", "terms of the eupl 1 2 licence", "license provided under the psf license", "x11 license"):
        every = {s.label for s in license_scan.signatures() if s.pattern.search(text) and all(k in text for k in s.keywords)}
        assert every and {m.signature.label for m in license_scan.scan(text)} == every
    assert all(any(t in k or k in t for t in license_scan.TRIGGERS for k in s.keywords) for s in license_scan.signatures())


def matched_texts(node):
    """Every text that a parsed pattern without unbounded repeats matches."""
    out = [""]
    for op, arg in node:
        kind = str(op)
        if kind == "LITERAL":
            ways = [chr(arg)]
        elif kind == "IN":
            ways = [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else (a[0], a[1]))]
        elif kind == "BRANCH":
            ways = [w for part in arg[1] for w in matched_texts(part)]
        elif kind == "SUBPATTERN":
            ways = matched_texts(arg[3])
        else:
            assert kind == "MAX_REPEAT", kind
            inner = matched_texts(arg[2])
            ways = [w * n for n in (arg[0], arg[1]) for w in inner]
        out = [a + w for a in out for w in ways]
    return set(out)


@pytest.mark.parametrize("label,pattern,words", [(a, b, c) for a, b, c in license_scan.NAMES])
def test_every_form_of_a_name_holds_its_keywords(label, pattern, words):
    for name in matched_texts(re._parser.parse(pattern)):
        assert any(k in f" {name}" for k in words), name
        for text in (f"released under {name}", f"this data is licensed under the {name}", f"subject to the {name}", f"copy of the {name}", f"{name} license"):
            assert label in {m.signature.label for m in license_scan.scan(text)}, text


def test_every_form_of_phrases_and_notices_holds_its_keywords():
    for pattern, keys, words, _, _ in license_scan.PHRASES:
        for text in matched_texts(re._parser.parse(pattern.format("NAME"))):
            assert all(k in text for k in keys) and any(k in text for k in words), text
    for _, pattern, keys, _, _ in license_scan.NOTICES:
        for text in matched_texts(re._parser.parse(re.sub(r"\{\d+,\d+\}", "{2}", pattern))):
            assert all(k in text for k in keys), text


@pytest.mark.parametrize("text,label", [
    ("Released under GPL 3", "gpl-3"), ("This work is available under CC BY-SA 4.0", "cc-by-sa"), ("distributed under the Apache 2.0", "apache-2"),
    ("subject to the MPL 2.0", "mpl-2"), ("a copy of the EUPL", "eupl"), ("Released under MIT", "mit"), ("provided to you under ISC", "isc"),
    ("This data is licensed under the Open Database License", "odbl")])
def test_labels_do_not_depend_on_other_text(text, label):
    for around in ("{}", "{} and some code by another licensor"):
        t = around.format(text)
        assert set(license_scan.detect(t)["labels"].split(",")) == labels_without_prefilter(t)
        assert label in license_scan.detect(t)["labels"].split(",")


def test_scan_query_and_spans(spark, make_docs):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op6_license_scan"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((d, *base_by_brute_force(t)) for d, t in rows)
    spans = license_scan.scan_licenses(make_docs([(1, "so: released under the MIT License!")]), spans=True).first().spans
    assert [(s.first, s.past, s.label) for s in spans] == [(1, 6, "mit"), (2, 6, "mit")]
    assert license_scan.scan_licenses(make_docs([]), spans=True).count() == 0


# Sketches


def test_sketches_of_odd_rows(make_docs, odd_rows):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (-3, "one"), (8, "The MIT license, é 漢字 Σ!"), (9, "a\x00b\x1fc\x85d e"), odd_rows[7], (10, odd_rows[7][1][:5000])]
    df = fingerprints.edited_fingerprints(make_docs(rows, clashing=True))
    same_as_oracle(df, fingerprints.EDITED_SQL, rows)
    same = {r.doc_id: r for r in df.collect()}
    assert same[4].fingerprint == same[-3].fingerprint and same[1].fingerprint == same[2].fingerprint


def test_repeated_rows_and_null_ids(make_docs, odd_rows):
    got = fingerprints.edited_fingerprints(make_docs(odd_rows, clashing=True)).collect()
    assert len(got) == len(odd_rows)
    order = sorted({(d, t or "") for d, t in odd_rows if d is not None}, key=lambda x: -x[0])
    assert {r.doc_id for r in got} == {d for d, _ in odd_rows}
    # The single row of the greatest run of distinct ids: 8 is followed by 7.
    text, nxt = dict(odd_rows)[8], dict(odd_rows)[7]
    n = len(text)
    want = hashlib.sha256((text[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest()
    assert next(r.edited_sha256 for r in got if r.doc_id == 8) == want and order


def test_one_and_no_document(make_docs):
    r = fingerprints.edited_fingerprints(make_docs([(5, "abcd")])).collect()
    assert [(x.doc_id, x.edited_sha256, x.near_next) for x in r] == [(5, hashlib.sha256(b"abab").hexdigest(), 1.0)]
    assert fingerprints.edited_fingerprints(make_docs([])).count() == 0


def test_containment_of_unequal_documents_and_unions(make_docs):
    rng = random.Random(0)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(20_000)]
    a, b = " ".join(long), " ".join(long[3000:5000])
    c = " ".join(long[:10_004])
    d = " ".join(long[10_000:])
    thin = fingerprints.THIN_THRESHOLD
    df = fingerprints.fingerprints(make_docs([(1, a), (2, b), (3, c), (4, d)]), threshold=thin)
    got = {r.doc_id: r.sketch for r in df.collect()}
    assert set(got[2]) <= set(got[1]) and abs(len(got[1]) / 20_000 - 1 / 16) < 0.01
    pair = df.groupBy().agg(F.max(F.when(F.col("doc_id") == 1, F.col("sketch"))).alias("a"), F.max(F.when(F.col("doc_id") == 2, F.col("sketch"))).alias("b"),
                            F.collect_list(F.when(F.col("doc_id") >= 3, F.col("sketch"))).alias("parts"))
    r = pair.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("near"), (fingerprints.merged(F.col("parts"), thin) == F.col("a")).alias("same")).first()
    assert r.near == 1.0 and r.same


def test_merged_sketches_are_those_of_the_union(make_docs):
    """Short documents, of which some have no hash below the threshold."""
    rng = random.Random(6)
    groups = [[" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.choice([0, 1, 3, 5, 6, 9]))) for _ in range(rng.randint(1, 3))] for _ in range(150)]
    parts = make_docs([(g, t) for g, texts in enumerate(groups) for t in texts])
    for threshold in (fingerprints.THRESHOLD, fingerprints.THIN_THRESHOLD):
        limit = int(threshold.ljust(15, "0"), 16)
        sketches = fingerprints.fingerprints(parts, threshold=threshold)
        got = {r.doc_id: r.s for r in sketches.groupBy("doc_id").agg(fingerprints.merged(F.collect_list("sketch"), threshold).alias("s")).collect()}
        for g, texts in enumerate(groups):
            hashes = set()
            for t in texts:
                w = t.split()
                hashes |= {int(hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:15], 16) for i in range(max(len(w) - 4, min(len(w), 1)))}
            below = sorted(h for h in hashes if h < limit)
            assert got[g] == (below or ([min(hashes)] if hashes else []))


def test_short_documents_keep_their_likeness(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 120)))) for i in range(400)]

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    errors = []
    for r in fingerprints.edited_fingerprints(make_docs(rows)).collect():
        text, n = rows[r.doc_id][1], r.n_chars
        a, b = shingles(text), shingles(text[: n - n // 2] + rows[r.next_doc_id][1][: n // 2])
        errors.append(abs(r.near_edited - len(a & b) / min(len(a), len(b))))
        assert r.near_edited > 0
    assert sum(errors) / len(errors) < 0.05 and sum(e > 0.2 for e in errors) <= 4


def test_sketch_query_plan_is_native(spark):
    df = queries.QUERIES["op10_document_fingerprints"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same_as_oracle(df, queries.ORACLES["op10_document_fingerprints"], rows)
