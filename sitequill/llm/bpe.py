"""Byte-pair encoding over batches of texts as ragged numpy arrays.

``Encoder`` cuts a batch of texts into pre-tokens with array operations (one
class per code point, boundaries from class changes), gives equal pre-tokens
one 64-bit key, and encodes each distinct unseen pre-token once with
``merge_ranks``: all sequences advance together, each by its own lowest-rank
pair per round. Results are kept in a bounded cache of the Python worker.

The vocabulary and merges come from a public tokenizer file whose path is a
parameter; nothing is trained or copied here.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import regex

from .ragged import disjoint_hash, ragged_index

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
NO_RANK = np.int64(1 << 40)
#: Sets the cache keys of special strings apart from equal ordinary text.
SPECIAL_KEY = np.uint64(0xD1B54A32D192ED03)
#: Distinct pre-tokens a worker remembers before it starts afresh (about 50
#: bytes each), and with their decoded text (about 150 bytes each).
CACHE_ENTRIES = 1_500_000
CACHE_ENTRIES_WITH_TEXT = 500_000
#: Symbols merged at once when unseen pre-tokens are encoded.
MERGE_SYMBOLS = 1 << 20
#: Texts beyond this many characters are encoded in parts (cut before white space).
PART_CHARS = 1 << 20


def _probed() -> np.ndarray:
    """Code points whose class is probed: planes 0 to 3 and the start of plane
    14, less surrogates and the space. The others are unassigned or private
    in every version of Unicode and therefore neither letter, number nor white space."""
    return np.array([*range(0x20), *range(0x21, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)])


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def class_table(path: str) -> np.ndarray:
    """Class of every code point (letter, number, white space or other) as the
    pre-tokenizer of the file sees it; packages differ in their Unicode tables.

    The pre-tokenizer cuts the code points in ascending order into runs of one
    class; the first of each run is then tried next to a letter, a symbol and
    white space. A worker does so once for a file."""
    cut = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    cp = _probed()
    spans = [span for _, span in cut("".join(map(chr, cp.tolist())))]
    heads = [chr(cp[a]) for a, _ in spans]
    kinds = np.full(len(heads), SPACE, np.uint8)
    for lead, kind in (("a", LETTER), ("!", OTHER)):
        end_of = dict(span for _, span in cut("".join(f"{lead}{c}\n" for c in heads)))
        kinds[[end_of.get(3 * i, 0) >= 3 * i + 2 for i in range(len(heads))]] = kind
    # White space is dropped or joined by the white space after it, a number is neither.
    end_of = dict(span for _, span in cut("".join(f"!{c}\n\n" for c in heads)))
    alone = np.array([end_of.get(4 * i + 1, 0) == 4 * i + 2 for i in range(len(heads))], bool)
    kinds[alone & (kinds == SPACE)] = NUMBER
    table = np.full(0x110000, OTHER, np.uint8)
    table[0x20] = SPACE
    # What a file drops lies between its runs, and is white space.
    of_probed = np.full(len(cp), SPACE, np.uint8)
    for (a, b), kind in zip(spans, kinds.tolist(), strict=True):
        of_probed[a:b] = kind
    table[cp] = of_probed
    return table


@lru_cache(maxsize=1)
def code_values() -> np.ndarray:
    """A scattered 64-bit value for every code point."""
    from .ragged import mix

    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the others
    take the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Token ids and ranked merges of a ``tokenizers`` JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.first = np.array([ids[c] for c in alphabet], np.int64)
        self.last = np.array([ids[c + suffix] for c in alphabet], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        #: Token made by the merge of each rank.
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self._pair_table((left << 32) | right)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.token_bytes_inside = _adjacent_bytes(ids, suffix, alphabet)

    def _pair_table(self, keys: np.ndarray) -> None:
        """Open-addressing table from pair to rank, under a quarter full."""
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.pair_keys = np.full(1 << self.bits, -1, np.int64)
        self.pair_ranks = np.full(1 << self.bits, NO_RANK, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.pair_keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.pair_keys[slot], self.pair_ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NO_RANK where the pair does not merge."""
        keys = (left << 32) | right
        slot = self._slots(keys)
        held = self.pair_keys[slot]
        out = np.where(held == keys, self.pair_ranks[slot], NO_RANK)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.pair_keys[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.pair_ranks[slot[open_[same]]]
            open_ = open_[~same & (held != -1)]
        return out


def _adjacent_bytes(ids: dict[str, int], suffix: str, alphabet: list[str]) -> np.ndarray:
    """256 x 256: whether two bytes stand side by side inside any token."""
    byte_of = {c: b for b, c in enumerate(alphabet)}
    seen = np.zeros((256, 256), bool)
    for token in ids:
        body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
        b = [byte_of[c] for c in body if c in byte_of]
        seen[b[:-1], b[1:]] = True
    return seen


def merge_ranks(symbols: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Encode many sequences at once; returns (ids, length of each sequence).

    Every round each live sequence merges all places of its lowest-rank pair,
    left to right (of overlapping places every second one). A merge never
    makes a pair of lower rank than its own, so this equals merging one place
    at a time. Finished sequences leave the arrays.
    """
    n = len(lengths)
    out_len = np.zeros(n, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    alive = np.flatnonzero(lengths > 0)
    sym, size = symbols.astype(np.int64), lengths[alive].astype(np.int64)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(size) - 1] = True
    rank = np.full(len(sym), NO_RANK)
    inner = np.flatnonzero(~last)
    rank[inner] = vocabulary.ranks(sym[inner], sym[inner + 1])
    while len(alive):
        low = np.minimum.reduceat(rank, np.cumsum(size) - size)
        over = low == NO_RANK
        if over.any():
            out_len[alive[over]] = size[over]
            gone = np.repeat(over, size)
            done.append((np.repeat(alive[over], size[over]), sym[gone]))
            sym, rank, last = sym[~gone], rank[~gone], last[~gone]
            alive, size, low = alive[~over], size[~over], low[~over]
            if not len(alive):
                break
        owner = np.repeat(np.arange(len(alive)), size)
        at = np.flatnonzero(rank == low[owner])
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) != 1
        run_start = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        at = at[(at - run_start) % 2 == 0]
        sym[at] = vocabulary.made[rank[at]]
        last[at] |= last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        size = size - np.bincount(owner[at], minlength=len(alive))
        sym, rank, last = sym[keep], rank[keep], last[keep]
        at = at - np.arange(len(at))
        before = at[at > 0] - 1
        near = np.concatenate([at, before[~last[before]]])
        rank[near] = NO_RANK
        near = near[~last[near]]
        rank[near] = vocabulary.ranks(sym[near], sym[near + 1])
    if not done:
        return np.zeros(0, np.int64), out_len
    owners = np.concatenate([o for o, _ in done])
    ids = np.concatenate([s for _, s in done])
    return ids[np.argsort(owners, kind="stable")], out_len


def encode_words(words: Sequence[bytes], vocabulary: Vocabulary, forced_cuts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word's bytes. With ``forced_cuts`` a word is first cut
    wherever two neighbouring bytes stand inside no token of the vocabulary;
    the fragments are encoded on their own and their ids concatenated."""
    ids, lengths = [], []
    i = 0
    while i < len(words):
        j, size = i, 0
        while j < len(words) and (j == i or size + len(words[j]) <= MERGE_SYMBOLS):
            size += len(words[j])
            j += 1
        part = words[i:j]
        n = np.fromiter(map(len, part), np.int64, len(part))
        raw = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum(n)
        sym = vocabulary.first[raw]
        filled = n > 0
        sym[ends[filled] - 1] = vocabulary.last[raw[ends[filled] - 1]]
        if forced_cuts and len(raw):
            cut = np.zeros(len(raw), bool)  # a fragment starts here
            cut[1:] = ~vocabulary.token_bytes_inside[raw[:-1], raw[1:]]
            cut[(ends - n)[filled]] = True
            starts = np.flatnonzero(cut)
            pieces = np.diff(np.append(starts, len(raw)))
            got, got_len = merge_ranks(sym, pieces, vocabulary)
            word_of = np.searchsorted(ends, starts, side="right")
            lengths.append(np.bincount(word_of, weights=got_len, minlength=len(part)).astype(np.int64))
        else:
            got, got_len = merge_ranks(sym, n, vocabulary)
            lengths.append(got_len)
        ids.append(got)
        i = j
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(lengths)


def _contractions(cp: np.ndarray, start: np.ndarray, piece_end: np.ndarray) -> list[tuple[int, int]]:
    """(place, length) of 's 't 're 've 'm 'll 'd that begin a pre-token."""
    found = []
    for i in np.flatnonzero((cp == 0x27) & start).tolist():
        tail = "".join(map(chr, cp[i + 1 : min(i + 3, piece_end[i])].tolist()))
        if tail[:1] and tail[0] in "stmd":
            found.append((i, 2))
        elif tail in ("re", "ve", "ll"):
            found.append((i, 3))
    return found


def _split_contractions(cp, start, piece_start) -> None:
    quotes = np.flatnonzero((cp == 0x27) & start)
    if not len(quotes):
        return
    ends = np.append(piece_start[1:], len(cp))
    end_at = np.zeros(len(cp), np.int64)
    end_at[quotes] = ends[np.searchsorted(piece_start, quotes, side="right") - 1]
    for i, n in _contractions(cp, start, end_at):
        start[i + 1] = False
        if i + n < end_at[i]:
            start[i + n] = True


def spaced_starts(cp: np.ndarray, kind: np.ndarray, piece_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens that take one leading space along:
    runs of letters, of numbers, of other characters; white space apart."""
    start = np.ones(len(cp), bool)
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(cp), bool)
    first[piece_start] = True
    start |= first
    # The last white space character before a word leaves its run; a space joins the word.
    word = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    start[word - 1] = True
    start[word] = cp[word - 1] != 0x20
    _split_contractions(cp, start, piece_start)
    s = np.flatnonzero(start)
    return s, np.append(s[1:], len(cp))


def bare_starts(cp: np.ndarray, kind: np.ndarray, piece_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens without white space: runs of letters,
    single numbers, runs of other characters."""
    start = np.ones(len(cp), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    start[piece_start] = True
    _split_contractions(cp, start, piece_start)
    s = np.flatnonzero(start)
    e = np.append(s[1:], len(cp))
    solid = kind[s] != SPACE
    return s[solid], e[solid]


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """Whether a code point is unknown to this Python's Unicode tables. Newer
    tables may compose it or give it a lower case."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


def fold_text(text: str, normalizer=None) -> str:
    """Composed form, lower case by single characters (so no final sigma).

    A text with a code point unknown to Python goes to the file's own
    ``normalizer``, which is slower."""
    if not text.isascii():
        if normalizer is not None and _unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Encoder:
    """Batch encoder for one vocabulary file.

    ``spaced`` picks the pre-token rule; ``fold`` normalises the text first.
    Special strings inside texts become their single id, as the library's
    default has it.
    """

    def __init__(self, path: str, spaced: bool = True, fold: bool = False, forced_cuts: bool = False, keep_text: bool = False) -> None:
        self.vocabulary = Vocabulary(path)
        self.classes = class_table(path)
        self.normalizer = _tokenizer(path).normalizer if fold else None
        self.starts = spaced_starts if spaced else bare_starts
        self.fold, self.forced_cuts, self.keep_text = fold, forced_cuts, keep_text
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        #: Keys live and die with this encoder; no text can be made to clash with another.
        self.seed = int.from_bytes(os.urandom(8), "little")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.decoded: list[str] = []

    def _pieces(self, text: str) -> list[tuple[str, bool]]:
        """Parts of a text and whether each is a special string of the raw
        text (folding may make an ordinary part look like one)."""
        parts = [text]
        if self.special and any(s in text for s in self.vocabulary.special):
            parts = [p for p in self.special.split(text) if p]
        out = []
        for p in parts:
            if p in self.vocabulary.special:
                out.append((p, True))
                continue
            if self.fold:
                p = fold_text(p, self.normalizer)
            at = 0
            while len(p) - at > PART_CHARS:
                m = _CUT.search(p, at + PART_CHARS)
                if not m:
                    break
                out.append((p[at : m.start() + 1], False))
                at = m.start() + 1
            out.append((p[at:], False))
        return [x for x in out if x[0]]

    def entries(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache entry of every pre-token in order, and offsets by text.

        Valid until the next call of ``entries``."""
        if len(self.keys) > (CACHE_ENTRIES_WITH_TEXT if self.keep_text else CACHE_ENTRIES):
            self._clear()
        counts = np.zeros(len(texts), np.int64)
        found: list[np.ndarray] = []
        batch: list[tuple[str, bool]] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if batch:
                entry, per_piece = self._encode_pieces(batch)
                found.append(entry)
                np.add.at(counts, np.array(owner), per_piece)
            batch.clear()
            owner.clear()
            size = 0

        for i, t in enumerate(texts):
            for p in self._pieces(t):
                if size + len(p[0]) > PART_CHARS:
                    flush()
                batch.append(p)
                owner.append(i)
                size += len(p[0])
        flush()
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), offsets

    def _encode_pieces(self, flagged: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [p for p, _ in flagged]
        whole = np.flatnonzero([f for _, f in flagged])
        big = "".join(pieces)
        cp = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece_start = np.cumsum(n) - n
        s, e = self.starts(cp, self.classes[cp], piece_start)
        if len(whole):
            s, e = self._whole_specials(piece_start[whole], n[whole], s, e)
        per_piece = np.diff(np.append(np.searchsorted(s, piece_start), len(s)))
        if not len(s):
            return np.zeros(0, np.int64), per_piece
        key = disjoint_hash(code_values()[cp], s, e, self.seed)
        special = np.zeros(len(s), bool)
        special[np.searchsorted(s, piece_start[whole])] = True
        key[special] ^= SPECIAL_KEY
        unique, where, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), bool)
        if not known.all():
            new = where[~known]
            self._learn(unique[~known], [big[i:j] for i, j in zip(s[new].tolist(), e[new].tolist(), strict=True)], special[new])
            at = np.searchsorted(self.keys, unique)
        return self.entry[at][back], per_piece

    def _whole_specials(self, start, size, s, e):
        """Special strings are one pre-token each, whatever the rule cut."""
        keep = np.ones(len(s), bool)
        for i, n in zip(start.tolist(), size.tolist(), strict=True):
            a, b = np.searchsorted(s, [i, i + n])
            keep[a + 1 : b] = False
            e[a] = i + n
        return s[keep], e[keep]

    def _learn(self, keys: np.ndarray, words: list[str], special: np.ndarray) -> None:
        ids, length = encode_words([w.encode() for w in words], self.vocabulary, self.forced_cuts)
        for i in np.flatnonzero(special).tolist():
            a = int(length[:i].sum())
            ids = np.concatenate([ids[:a], [self.vocabulary.special[words[i]]], ids[a + length[i] :]])
            length[i] = 1
        first = len(self.length)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.length = np.concatenate([self.length, length])
        if self.keep_text:
            names, at = self.vocabulary.tokens, 0
            listed = ids.tolist()
            for k in length.tolist():
                self.decoded.append(" ".join([names[x] for x in listed[at : at + k]]))
                at += k
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.entry = np.insert(self.entry, where, first + np.arange(len(keys)))

    def token_counts(self, texts: Sequence[str]) -> np.ndarray:
        from .ragged import segment_sums

        entry, offsets = self.entries(texts)
        return segment_sums(self.length[entry], offsets)

    def token_ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array, and offsets by text."""
        entry, offsets = self.entries(texts)
        length = self.length[entry]
        ids = self.ids[ragged_index(self.start[entry], length)]
        ends = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        return ids, ends[offsets]


_CUT = regex.compile(r"\S(?=\p{White_Space})")

_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, **options) -> Encoder:
    """The worker's encoder for a file; its cache lasts over tasks."""
    key = (path, *sorted(options.items()))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, **options)
    return _ENCODERS[key]
