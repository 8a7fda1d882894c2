"""BPE codec, token counts and packing against the tokenizers library."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitequill.llm import queries
from sitequill.llm.bpe import Encoder, Vocabulary, class_table, encode_words, encoder
from sitequill.llm.bpe_codec import encode_decode, encode_decode_digests
from sitequill.llm.packing import pack_documents
from sitequill.llm.ragged import OTHER_POWERS, POWERS, PRIME, disjoint_hash, mix, prefix_sums, slice_hash
from sitequill.llm.token_counts import token_counts

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXT = st.text(st.one_of(st.sampled_from(list("aest' .,\n1é")), st.characters(codec="utf-8")), max_size=60)
SPECIAL = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|startoftext|> x <|endoftext|>", "<|endoftext", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def _mine(path, texts):
    e = encoder(path) if path == BYTE else encoder(path, spaced=False, fold=True, forced_cuts=True, keep_text=True)
    ids, ends = e.token_ids(texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def _theirs(tok, texts):
    return [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=30))
def test_encoders_equal_the_library(texts):
    for path in (BYTE, WORD):
        tok = Tokenizer.from_file(path) if path not in _TOKS else _TOKS[path]
        _TOKS[path] = tok
        assert _mine(path, texts) == _theirs(tok, texts)


_TOKS: dict = {}


def test_special_strings_contractions_and_runs(library):
    texts = [*SPECIAL, "it's 'tis we'll 'd''s!'s", "aaaa" * 3000, "ab" * 2000, "  \n\n  x", "'S 'RE", "ΑΣ ΟΔΟΣ İ", "x" * 5000 + " " * 5000]
    for path, tok in library.items():
        assert _mine(path, texts) == _theirs(tok, texts)


def test_long_texts_are_cut_in_parts(library, monkeypatch):
    import sitequill.llm.bpe as bpe

    monkeypatch.setattr(bpe, "PART_CHARS", 50)
    texts = [" ".join(f"it's word{i}\n\n {i}" for i in range(60)), "short", ""]
    e = Encoder(BYTE)
    ids, ends = e.token_ids(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == _theirs(library[BYTE], texts)


def test_forced_cuts_change_nothing():
    v = Vocabulary(WORD)
    words = [w.encode() for w in ("hello", "zqxjk", "漢字", "éàü", "a" * 50, "naïve")]
    with_cuts, plain = encode_words(words, v, True), encode_words(words, v, False)
    assert with_cuts[0].tolist() == plain[0].tolist() and with_cuts[1].tolist() == plain[1].tolist()
    assert not v.token_bytes_inside.all() and v.token_bytes_inside.any()


def test_classes_of_code_points():
    for path in (BYTE, WORD):
        t = class_table(path)
        assert [t[ord(c)] for c in "aé1² \n\x85!_"] == [1, 1, 2, 2, 3, 3, 3, 0, 0]


def _code_points():
    """All of the planes that hold characters, and some of the others."""
    return [*range(0xD800), *range(0xE000, 0x34000), *range(0x34000, 0xE0000, 997), *range(0xE0000, 0xE2000), *range(0xE2000, 0x110000, 997)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_code_point_as_the_library_has_it(library, path):
    every = _code_points()
    for i in range(0, len(every), 20_000):
        texts = [t for c in map(chr, every[i : i + 20_000]) for t in (f"a{c}1{c}'s{c}b", f":{c}'{c}s {c}  {c}", f"{c}'t{c}{c} {c}2é{c}")]
        mine, theirs = _mine(path, texts), _theirs(library[path], texts)
        assert [t for t, a, b in zip(texts, mine, theirs, strict=True) if a != b] == []


def _thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_words_stay_apart(library, n):
    texts = list(_thue_morse(n))
    for path, tok in library.items():
        assert _mine(path, texts) == _theirs(tok, texts)
        assert _mine(path, [" ".join(texts)]) == _theirs(tok, [" ".join(texts)])


def test_hashes_of_slices_stay_apart():
    words = [mix(np.frombuffer(t.encode(), np.uint8).astype(np.uint64)) for t in _thue_morse(1 << 14)]
    seen = set()
    for n in (1 << k for k in range(4, 15)):
        for w in words:
            start, end = np.array([0]), np.array([n])
            seen |= {int(disjoint_hash(w, start, end)[0]), *(int(slice_hash(*prefix_sums(w, p), start, end)[0]) for p in (POWERS, OTHER_POWERS))}
    assert len(seen) == 11 * 2 * 3


def test_slice_hash_by_definition():
    values = np.random.default_rng(5).integers(0, 1 << 63, 300, dtype=np.uint64)
    sums, down = prefix_sums(values)
    p, total = int(PRIME), 0
    for i, v in enumerate(values.tolist()):
        total = (total + (v >> 3) * pow(POWERS.bases[0], i, p)) % p
        assert int(sums[i + 1]) == total
    again = prefix_sums(np.concatenate([values[40:90], values]))
    same = slice_hash(*again, np.array([0, 90]), np.array([50, 140]))
    assert same[0] == same[1] == slice_hash(sums, down, np.array([40]), np.array([90]))[0]


def test_cache_starts_afresh(library, monkeypatch):
    import sitequill.llm.bpe as bpe

    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    e = Encoder(BYTE)
    for texts in (["one two three four five"], ["five six"], ["one two"]):
        ids, _ = e.token_ids(texts)
        assert ids.tolist() == _theirs(library[BYTE], texts)[0]


def test_counts_of_odd_rows(make_docs, odd_rows, library):
    got = token_counts(make_docs(odd_rows, clashing=True), BYTE).collect()
    texts = [t or "" for _, t in odd_rows]
    want = [(d, len(t.encode()), len(i), len(i) > 1024) for (d, _), t, i in zip(odd_rows, texts, _theirs(library[BYTE], texts), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}


def test_codec_of_odd_rows(make_docs, odd_rows, library):
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(SPECIAL))]
    docs = make_docs(rows, clashing=True)
    tok = library[WORD]
    ids = _theirs(tok, [t or "" for _, t in rows])
    decoded = [tok.decode(i, skip_special_tokens=False) for i in ids]
    whole = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encode_decode(docs, WORD).collect())
    assert whole == Counter((d, tuple(i), t) for (d, _), i, t in zip(rows, ids, decoded, strict=True))
    digests = Counter(map(tuple, encode_decode_digests(docs, WORD).collect()))
    assert digests == Counter(
        (d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        for (d, _), i, t in zip(rows, ids, decoded, strict=True))


def _check_packing(rows, pieces, tok, capacity=2048, most_padding=None):
    ids = {}
    for (d, t), i in zip(rows, _theirs(tok, [t or "" for _, t in rows]), strict=True):
        ids.setdefault(d, []).append([*i, 1])
    covered = Counter()
    for p in pieces:
        own = [x for x in ids[p.doc_id] if len(x) == p.doc_tokens]
        assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in own)
        covered[p.doc_id] += p.length
    assert covered == Counter({d: sum(map(len, x)) for d, x in ids.items()})
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    padding = 0
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    total = sum(covered.values())
    if most_padding is not None:
        assert padding <= most_padding * total
    return padding / max(total, 1)


def test_packing_of_odd_rows(make_docs, odd_rows, library):
    docs = make_docs(odd_rows, clashing=True).repartition(3)
    _check_packing(odd_rows, pack_documents(docs, BYTE).collect(), library[BYTE])


def test_packing_with_small_windows(make_docs, library):
    rows = [(i, " ".join(["tok"] * (i * 7 % 90))) for i in range(400)]
    pieces = pack_documents(make_docs(rows).repartition(4), BYTE, capacity=64, open_windows=4).collect()
    assert _check_packing(rows, pieces, library[BYTE], 64) < 0.1


def test_empty_table(make_docs):
    none = make_docs([])
    assert token_counts(none, BYTE).count() == 0
    assert encode_decode_digests(none, WORD).count() == 0
    assert pack_documents(none, BYTE).count() == 0


def test_queries_on_the_small_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    byte_ids = dict(zip([d for d, _ in rows], _theirs(library[BYTE], [t or "" for _, t in rows]), strict=True))
    assert {r.doc_id: r.n_tokens for r in queries.QUERIES["op9_token_counts"](spark, sf).collect()} == {d: len(i) for d, i in byte_ids.items()}
    word_ids = _theirs(library[WORD], [t or "" for _, t in rows])
    assert {r.doc_id: r.n_tokens for r in queries.QUERIES["op2_bpe_codec"](spark, sf).collect()} == {d: len(i) for (d, _), i in zip(rows, word_ids, strict=True)}
    _check_packing(rows, queries.QUERIES["op8_packing"](spark, sf).collect(), library[BYTE], most_padding=0.02)
