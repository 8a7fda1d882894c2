"""License detection by ordered signature rules.

Texts are reduced to lower-case words joined by one space. A signature is a
regular expression over these words, keywords that each of its matches holds,
groups of keywords of which each match holds one, a label, a priority and a
weight; the table below is the product of license names and the phrases in
which they are invoked. An Aho-Corasick pass finds which keywords a text
holds, and only signatures that can match by them are run: the pass saves
time and decides nothing. Of the matches, one whose words lie inside those of a match of
higher priority (or of equal priority and greater length) is suppressed.

Three base phrases are signatures too; their labels always stay. One narrow
pass over the scan, no shuffle.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import id_text, map_texts

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases that are always looked for, and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

_V = r"(?: v| version| ver)? ?"

#: License names as patterns over words: (label, pattern, keywords of which
#: each match holds one, where a space comes before the first word too).
NAMES = (
    ("mit", r"(?:mit|expat)(?: x11)?", (" mit", " expat")),
    ("mit-0", r"mit 0|mit no attribution", (" mit 0", " mit no")),
    ("x11", r"x11", (" x11",)),
    ("isc", r"isc|internet systems consortium", (" isc", " internet systems")),
    ("apache-1", rf"apache(?: software)?(?: foundation)? license{_V}1(?: [01])?|apache 1(?: [01])?", (" apache",)),
    ("apache-2", rf"apache(?: software)?(?: foundation)? license{_V}2(?: 0)?|apache 2(?: 0)?|asl 2(?: 0)?|al2", (" apache", " asl", " al2")),
    ("apache", r"apache(?: software)?(?: foundation)?", (" apache",)),
    ("bsd-2-clause", r"(?:bsd 2(?: clause)?|(?:simplified|freebsd|two clause|2 clause) bsd)", ("bsd",)),
    ("bsd-3-clause", r"(?:bsd 3(?: clause)?|(?:modified|new|revised|three clause|3 clause) bsd)", ("bsd",)),
    ("bsd-4-clause", r"(?:bsd 4(?: clause)?|(?:original|old|four clause|4 clause) bsd)", ("bsd",)),
    ("0bsd", r"(?:0bsd|zero clause bsd)", ("bsd",)),
    ("bsd", r"bsd(?: style)?", (" bsd",)),
    ("gpl-1", rf"(?:gnu )?(?:general public license|gpl){_V}1(?: 0)?|gplv1", ("general public", " gpl")),
    ("gpl-2", rf"(?:gnu )?(?:general public license|gpl){_V}2(?: 0)?|gplv2|gpl2", ("general public", " gpl")),
    ("gpl-3", rf"(?:gnu )?(?:general public license|gpl){_V}3(?: 0)?|gplv3|gpl3", ("general public", " gpl")),
    ("gpl", r"(?:gnu )?general public license|gnu gpl|gpl", ("general public", " gpl")),
    ("lgpl-2", rf"(?:gnu )?(?:library|lesser) (?:general public license|gpl){_V}2(?: [01])?|lgpl{_V}2(?: [01])?|lgplv2", ("library g", "lesser g", " lgpl")),
    ("lgpl-3", rf"(?:gnu )?lesser (?:general public license|gpl){_V}3(?: 0)?|lgpl{_V}3(?: 0)?|lgplv3", ("lesser g", " lgpl")),
    ("lgpl", r"(?:gnu )?(?:library|lesser) general public license|lgpl", ("library g", "lesser g", " lgpl")),
    ("agpl-3", rf"(?:gnu )?affero (?:general public license|gpl){_V}3(?: 0)?|agpl{_V}3(?: 0)?|agplv3", ("affero", " agpl")),
    ("agpl", r"(?:gnu )?affero general public license|agpl", ("affero", " agpl")),
    ("gfdl", r"(?:gnu )?free documentation license(?: version)?(?: 1(?: [123])?)?|gfdl", ("free documentation", " gfdl")),
    ("mpl-1", rf"(?:mozilla public license|mpl){_V}1(?: [01])?", (" mozilla", " mpl")),
    ("mpl-2", rf"(?:mozilla public license|mpl){_V}2(?: 0)?", (" mozilla", " mpl")),
    ("mpl", r"mozilla public license|mpl", (" mozilla", " mpl")),
    ("epl-1", rf"(?:eclipse public license|epl){_V}1(?: 0)?", (" eclipse", " epl")),
    ("epl-2", rf"(?:eclipse public license|epl){_V}2(?: 0)?", (" eclipse", " epl")),
    ("eupl", rf"european union public licen[cs]e(?:{_V}1(?: [012])?)?|eupl(?:{_V}1(?: [012])?)?", (" european union", " eupl")),
    ("cddl", rf"common development and distribution license(?:{_V}1(?: [01])?)?|cddl(?:{_V}1(?: [01])?)?", (" common development", " cddl")),
    ("cpl", rf"common public license(?:{_V}1(?: 0)?)?", (" common public",)),
    ("artistic", rf"artistic license(?:{_V}[12](?: 0)?)?", (" artistic",)),
    ("bsl-1", rf"boost software license(?:{_V}1(?: 0)?)?", (" boost",)),
    ("zlib", r"zlib(?: libpng)?", (" zlib",)),
    ("unlicense", r"unlicense", (" unlicense",)),
    ("wtfpl", r"wtfpl", (" wtfpl",)),
    ("cc0", rf"cc0(?:{_V}1(?: 0)?)?|creative commons zero", (" cc0", " creative commons")),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1234] ?[05]?)?|creative commons attribution non ?commercial no ?deriv(?:ative)?s", (" cc by", " creative commons")),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1234] ?[05]?)?|creative commons attribution non ?commercial share ?alike", (" cc by", " creative commons")),
    ("cc-by-nc", r"cc by nc(?: [1234] ?[05]?)?|creative commons attribution non ?commercial", (" cc by", " creative commons")),
    ("cc-by-nd", r"cc by nd(?: [1234] ?[05]?)?|creative commons attribution no ?deriv(?:ative)?s", (" cc by", " creative commons")),
    ("cc-by-sa", r"cc by sa(?: [1234] ?[05]?)?|creative commons attribution share ?alike", (" cc by", " creative commons")),
    ("cc-by", r"cc by(?: [1234] ?[05]?)?|creative commons attribution", (" cc by", " creative commons")),
    ("odbl", r"open database license|odbl", (" open database", " odbl")),
    ("ofl-1", r"(?:sil )?open font license(?: version)?(?: 1 ?1?)?|ofl 1 1", ("open font", " ofl")),
    ("postgresql", r"postgresql", (" postgresql",)),
    ("psf", r"python software foundation|psf", (" python software", " psf")),
    ("openssl", r"openssl", (" openssl",)),
    ("vim", r"vim", (" vim",)),
    ("ms-pl", r"microsoft public", (" microsoft",)),
    ("ms-rl", r"microsoft reciprocal", (" microsoft",)),
    ("sspl", r"server side public license(?: v1)?|sspl", (" server side", " sspl")),
    ("busl", r"business source license(?: 1 1)?|busl 1 1", (" business source", " busl")),
    ("proprietary", r"proprietary|commercial", (" proprietary", " commercial")),
)

#: Phrases around a name: (pattern, keywords that each match holds, keywords
#: of which each match holds one, priority, weight).
PHRASES = (
    (r"spdx license identifier (?:{0})", ("spdx",), ("spdx",), 100, 1.0),
    (r"(?:licen[cs]ed|released|distributed|published|available|provided|made available|covered|governed)(?: to you)? (?:under|by)(?: the)?(?: terms of)?(?: the)? (?:{0})(?: licen[cs]e| public licen[cs]e)?", ("e",), ("ed under", "ed by", "ed to you", "able under", "able by", "able to you"), 90, 1.0),
    (r"(?:subject to|in accordance with|in compliance with|according to|pursuant to)(?: the)?(?: terms of)?(?: the)? (?:{0})(?: licen[cs]e)?", ("t",), ("subject to", "accordance with", "compliance with", "according to", "pursuant to"), 80, 0.9),
    (r"(?:under|terms of)(?: either)? (?:a |an |the )?(?:{0}) licen[cs]e", ("licen",), ("licen",), 70, 0.8),
    (r"(?:copy|text|version) of the (?:{0})(?: licen[cs]e)?", ("of the",), ("copy of the", "text of the", "version of the"), 60, 0.7),
    (r"licen[cs]e (?:is )?(?:{0})", ("licen",), ("licen",), 50, 0.6),
    (r"(?:{0}) licen[cs]e", ("licen",), ("licen",), 40, 0.5),
)

#: Notices that name no license: (label, pattern, keywords, priority, weight).
NOTICES = (
    ("copyright-notice", r"copyright(?: c)? (?:19|20)[0-9][0-9]", ("copyright",), 30, 0.3),
    ("all-rights-reserved", r"all rights reserved", ("reserved",), 30, 0.3),
    ("public-domain", r"(?:released into|dedicated to|placed in|in) the public domain", ("public domain",), 90, 0.9),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("permission",), 95, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", ("permission",), 95, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", ("redistribution",), 95, 1.0),
    ("gpl", r"this program is free software you can redistribute it and or modify it", ("redistribute",), 85, 0.9),
    ("apache-2", r"www apache org licenses license 2 0", ("apache",), 95, 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",), 95, 1.0),
    ("cc", r"creativecommons org licenses [a-z ]{2,12}[0-9]", ("creativecommons",), 60, 0.7),
)


class Signature(NamedTuple):
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    weight: float
    base: bool
    one_of: tuple[tuple[str, ...], ...]


class Match(NamedTuple):
    start: int
    end: int
    signature: Signature


def _whole_words(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")


@lru_cache(maxsize=1)
def signatures() -> tuple[Signature, ...]:
    """All signatures, highest priority first."""
    out = [Signature(label, _whole_words(phrase), tuple(phrase.split()[-1:]) + ("licen",) * ("license" in phrase), 110, 1.0, True, ()) for phrase, label in BASE_PHRASES]
    for label, name, own in NAMES:
        for phrase, keys, words, priority, weight in PHRASES:
            out.append(Signature(label, _whole_words(phrase.format(name)), keys, priority, weight, False, (own, words)))
    out += [Signature(label, _whole_words(p), keys, priority, weight, False, ()) for label, p, keys, priority, weight in NOTICES]
    return tuple(sorted(out, key=lambda s: -s.priority))


@lru_cache(maxsize=1)
def _gates() -> tuple[tuple[Signature, tuple[frozenset[str], ...]], ...]:
    """Signatures, each with its groups of keywords; where it has groups they
    imply its single keywords."""
    return tuple((s, tuple(frozenset(g) for g in s.one_of or [(k,) for k in s.keywords])) for s in signatures())


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in {k for _, groups in _gates() for g in groups for k in g}:
        found.add_word(word, word)
    found.make_automaton()
    return found


#: Without one of these no signature can match, so the text is not scanned.
TRIGGERS = tuple(sorted({"cc by nc"} | {k for _, _, words, _, _ in PHRASES for k in words} | {k for *_, keys, _, _ in NOTICES for k in keys}))


def scan(joined: str) -> list[Match]:
    """All matches in words joined by one space, in order of priority."""
    if not any(t in joined for t in TRIGGERS):
        return []
    present = {word for _, word in _automaton().iter(" " + joined)}
    found = []
    for s, groups in _gates():
        if not any(present.isdisjoint(g) for g in groups):
            found += [Match(m.start(), m.end(), s) for m in s.pattern.finditer(joined)]
    return found


def suppressed(matches: list[Match]) -> list[Match]:
    """Matches that lie inside no match of higher priority, or of equal
    priority and greater length (of equal ones the first label stays)."""
    order = sorted(matches, key=lambda m: (-m.signature.priority, m.start - m.end, m.start, m.signature.label))
    kept: list[Match] = []
    starts: list[int] = []  # of kept matches, with the furthest end so far
    reach: list[int] = []
    for m in order:
        i = bisect.bisect_right(starts, m.start)
        if i and reach[i - 1] >= m.end:
            continue
        kept.append(m)
        starts.insert(i, m.start)
        reach.insert(i, max(m.end, reach[i - 1] if i else 0))
        for j in range(i + 1, len(reach)):
            if reach[j] >= m.end:
                break
            reach[j] = m.end
    return kept


def detect(text: str) -> dict:
    """Result fields of one text."""
    words = _WORD.findall(text.encode().lower().decode())
    joined = " ".join(words)
    matches = scan(joined)
    base = [m for m in matches if m.signature.base]
    kept = suppressed(matches)
    starts = [0, *accumulate(len(w) + 1 for w in words)] if matches else []
    places = [bisect.bisect_left(starts, m.start) for m in base]
    base_labels = {m.signature.label for m in base}
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {m.signature.label for m in kept})),
        "score": max((m.signature.weight for m in kept), default=0.0),
        "spans": [(bisect.bisect_left(starts, m.start), bisect.bisect_right(starts, m.end - 1), m.signature.label) for m in sorted(kept, key=lambda m: (m.start, m.end))],
    }


FIELDS = (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"),
          ("labels", "string"), ("score", "double"))


def scan_licenses(docs: DataFrame, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score) of every row; with ``spans`` also the surviving detections as
    (first word, word past the last, label).

    Labels are distinct, sorted and comma-joined, the empty string where
    there are none; first_word and last_word are null without a base phrase;
    score is the weight of the surest surviving detection, 0 without one.
    Null text is empty. Repeated rows and null ids are scanned like any other
    row; an empty table gives an empty result; other columns are not read.
    """
    fields = [*FIELDS, *([("spans", "array<struct<first:bigint,past:bigint,label:string>>")] if spans else [])]

    def run(texts: list[str]) -> dict:
        import pyarrow as pa

        found = [detect(t) for t in texts]
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        out = {name: pa.array([f[name] for f in found], kinds[kind]) for name, kind in FIELDS}
        if spans:
            item = pa.struct([("first", pa.int64()), ("past", pa.int64()), ("label", pa.string())])
            out["spans"] = pa.array([[{"first": a, "past": b, "label": x} for a, b, x in f["spans"]] for f in found], pa.list_(item))
        return out

    return map_texts(id_text(docs, id_col, text_col), run, fields)
