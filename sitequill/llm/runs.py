"""Periodic runs of words by maximal-pair enumeration.

A maximal pair is two places of a text from which the same words follow for
``n`` words, with different words before and after. If the places are ``d``
apart, the stretch they cover, n + d words, has period d and can be extended to
neither side. So the pairs whose distance is small enough against their length
are the periodic stretches themselves; nothing is extended or searched for
afterwards. Of several distances of one stretch the least is its period.

1. Places whose next ``SEED`` words occur twice in their text are sorted by
   what follows (prefix doubling; places leave once they are alone), for all
   texts of a chunk at once with arrays.
2. Neighbours in that order and the lengths they share give the LCP-interval
   tree. It is walked bottom-up; a node holds its places in ascending order,
   all of them and by the word on their left (class lists).
3. When two subtrees meet at a node of length n, each place of the smaller one
   looks up the places of the other within the greatest distance that n allows,
   either class by class, leaving out its own, or all of them, whichever is
   fewer. These are the maximal pairs of bounded distance.

Parts of the order in which even the closest places are too far apart for the
longest shared length hold no such pair and are left out before the walk.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import id_text, map_texts
from .ragged import segment_sums
from .substring_dedup import Words

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that a qualifying pair shares at least: with distance d it shares
#: max(6 - d, 3 * d) or more.
SEED = 5


class Order(NamedTuple):
    """Places that share SEED words with another of their text, in
    lexicographic order of what follows; ``shared`` is the number of words that
    each shares with the place before it (0 at the start of a part)."""

    places: np.ndarray
    shared: np.ndarray


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Number of rows with a smaller key (first key first), for each row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return out


def sorted_places(words: np.ndarray, first: np.ndarray) -> Order:
    """``words`` are word codes of all texts, ``first`` the index of each
    text's first word, and the end."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    whole = np.flatnonzero(np.arange(n) + SEED <= end)
    empty = Order(np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(whole) < 2:
        return empty
    # Places that are not alone with their first SEED words, by a hash of them.
    key = text[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(SEED):
        key = (key ^ (words[whole + i] + np.uint64(i))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    ordered = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[ordered[1:]] == key[ordered[:-1]]
    seeds = np.sort(whole[ordered[same[1:] | same[:-1]]])
    if not len(seeds):
        return empty
    # The doubling also reads ranks SEED words on; beyond a text's end stands 0.
    known = np.union1d(seeds, (seeds + SEED)[seeds + SEED < end[seeds]])
    slot = np.full(n, -1, np.int64)
    slot[known] = np.arange(len(known))
    columns = [np.where(known + i < end[known], words[np.minimum(known + i, n - 1)], np.uint64(0)) for i in range(SEED)]
    rank = _ranks(text[known], *columns)
    levels, width = [rank], SEED
    active = slot[seeds]
    while True:
        counts = np.bincount(rank[active], minlength=len(known))
        active = active[counts[rank[active]] > 1]
        if not len(active):
            break
        ahead = known[active] + width
        inside = ahead < end[known[active]]
        next_slot = slot[np.minimum(ahead, n - 1)]
        follow = np.where(inside & (next_slot >= 0), rank[next_slot], -1)
        own = rank[active]
        order = np.lexsort((follow, own))
        group = own[order]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[order[1:]] != follow[order[:-1]])
        start = np.ones(len(order), bool)
        start[1:] = group[1:] != group[:-1]
        at = np.arange(len(order))
        offset = at[new][np.cumsum(new) - 1] - at[start][np.cumsum(start) - 1]
        rank = rank.copy()
        rank[active[order]] = group + offset
        levels.append(rank)
        width *= 2
    places = seeds[np.argsort(rank[slot[seeds]], kind="stable")]
    return Order(places, _shared(places, words, text, end, known, slot, levels))


def _shared(places, words, text, end, known, slot, levels) -> np.ndarray:
    """Words that each place shares with the one before it in the order."""
    a, b = places[:-1], places[1:]
    got = np.zeros(len(a), np.int64)
    live = text[a] == text[b]
    room = np.minimum(end[a] - a, end[b] - b)
    last = len(words) - 1
    for level in range(len(levels) - 1, -1, -1):
        width = SEED << level
        sa, sb = slot[np.minimum(a + got, last)], slot[np.minimum(b + got, last)]
        hit = live & (got + width <= room) & (sa >= 0) & (sb >= 0)
        hit &= levels[level][sa] == levels[level][sb]
        got[hit] += width
    for _ in range(SEED - 1):
        hit = live & (got < room)
        hit &= words[np.minimum(a + got, last)] == words[np.minimum(b + got, last)]
        got[hit] += 1
        live &= hit
    return np.concatenate([[0], np.where(got >= SEED, got, 0)])


class _Node:
    """Places of a subtree: all, and by the word on their left."""

    __slots__ = ("every", "classes")

    def __init__(self, place: int, left: int) -> None:
        self.every = [place]
        self.classes = {left: [place]}


def _meet(a: _Node, b: _Node, shared: int, left_of, found: dict) -> _Node:
    """Maximal pairs between two subtrees of one interval, then their union."""
    if len(a.every) < len(b.every):
        a, b = b, a
    reach = shared // (LEAST_PERIODS - 1)
    least = LEAST_WORDS - shared
    for own, places in b.classes.items():
        for p in places:
            i, j = bisect_left(a.every, p - reach), bisect_right(a.every, p + reach)
            if i == j:
                continue
            if j - i <= len(a.classes):
                near = [x for x in a.every[i:j] if left_of(x) != own]
            else:
                near = []
                for left, others in a.classes.items():
                    if left != own:
                        k = bisect_left(others, p - reach)
                        while k < len(others) and others[k] <= p + reach:
                            near.append(others[k])
                            k += 1
            for x in near:
                start, distance = (x, p - x) if x < p else (p, x - p)
                if distance >= least:
                    stretch = (start, distance + shared)
                    if distance < found.get(stretch, distance + 1):
                        found[stretch] = distance
    if len(b.every) > 8:
        a.every = sorted(a.every + b.every)
    else:
        for p in b.every:
            insort(a.every, p)
    for left, places in b.classes.items():
        held = a.classes.get(left)
        if held is None:
            a.classes[left] = places
        elif len(places) > 8:
            a.classes[left] = sorted(held + places)
        else:
            for p in places:
                insort(held, p)
    return a


def _walk(places: list[int], shared: list[int], left: list[int], found: dict) -> None:
    """Bottom-up over the LCP-interval tree of one part of the order."""
    left_of = dict(zip(places, left, strict=True)).__getitem__
    stack: list[tuple[int, _Node]] = []
    node = _Node(places[0], left[0])
    for i in range(1, len(places)):
        n = shared[i]
        while stack and stack[-1][0] > n:
            length, before = stack.pop()
            node = _meet(before, node, length, left_of, found)
        if stack and stack[-1][0] == n:
            node = _meet(stack.pop()[1], node, n, left_of, found)
        stack.append((n, node))
        node = _Node(places[i], left[i])
    while stack:
        length, before = stack.pop()
        node = _meet(before, node, length, left_of, found)


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of every text, in order of start
    and period; starts count over all texts.

    ``words`` are word codes (equal words, equal codes, none 0), ``first`` the
    index of each text's first word, and the end."""
    places, shared = sorted_places(words, first)
    found: dict[tuple[int, int], int] = {}
    if len(places):
        head = np.flatnonzero(shared == 0)
        part = np.cumsum(shared == 0) - 1
        # The closest two places of each part, against its longest shared length.
        order = np.lexsort((places, part))
        gap = np.full(len(places), len(words), np.int64)
        gap[1:] = np.where(part[order[1:]] == part[order[:-1]], places[order[1:]] - places[order[:-1]], len(words))
        close = np.minimum.reduceat(gap, head) <= np.maximum.reduceat(shared, head) // (LEAST_PERIODS - 1)
        starts = np.zeros(len(words), bool)
        starts[first[:-1][first[:-1] < len(words)]] = True
        # Codes of the words on the left; a text's first place has a class of its own.
        left = np.where(starts[places], np.uint64(0), words[np.maximum(places - 1, 0)])
        ends = np.append(head[1:], len(places))
        for i, j in zip(head[close].tolist(), ends[close].tolist(), strict=True):
            _walk(places[i:j].tolist(), shared[i:j].tolist(), left[i:j].tolist(), found)
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.array([(s, n, d) for (s, n), d in found.items()], np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def planted(words: np.ndarray, first: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Index of the word that stands at each place when texts are made periodic
    from a place on: with h the text's seed and g = h // 10, where h % 10 is 0,
    from word a = g % n on with period 1 + (n - a) // (3 + g % 8)."""
    at = np.arange(len(words))
    n = np.diff(first)
    chosen = np.flatnonzero((seeds % 10 == 0) & (n > 0))
    for i in chosen.tolist():
        g, size, base = int(seeds[i]) // 10, int(n[i]), int(first[i])
        a = g % size
        period = 1 + (size - a) // (3 + g % 8)
        at[base + a : base + size] = base + a + np.arange(size - a) % period
    return at


def _digests(texts: list[str], seeds: np.ndarray | None) -> dict:
    w = Words(texts)
    at = np.arange(len(w.start)) if seeds is None else planted(w.start, w.first, seeds)
    codes = w.hash[at] | np.uint64(1)
    runs = find_runs(codes, w.first)
    owner = np.searchsorted(w.first, runs[:, 0], side="right") - 1
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    # A run's words beyond its first period are dropped.
    drops = np.zeros(len(codes) + 1, np.int64)
    np.add.at(drops, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drops, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(drops[:-1]) == 0
    n_kept = segment_sums(kept, w.first)
    start, end = w.start[at[kept]].tolist(), w.end[at[kept]].tolist()
    best, listed, collapsed, k = [], [], [], 0
    for i in range(len(texts)):
        own = runs[edge[i] : edge[i + 1]] - np.array([w.first[i], 0, 0])
        rows = own.tolist()
        listed.append(hashlib.sha256("".join([f"{s},{n},{p}\n" for s, n, p in rows]).encode()).hexdigest())
        best.append(_most_periodic(rows))
        raw, m = w.raw, int(n_kept[i])
        collapsed.append(hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(start[k : k + m], end[k : k + m], strict=True)])).hexdigest())
        k += m
    columns = {"n_runs": np.diff(edge).astype(np.int64)}
    for j, name in enumerate(("start", "length", "period", "exponent_milli")):
        columns[name] = [None if x is None else x[j] for x in best]
    return columns | {"runs_sha256": listed, "collapsed_sha256": collapsed}


def _most_periodic(rows: list[list[int]]) -> tuple | None:
    """(start, length, period, thousandths of length / period) of the run with
    the greatest ratio; of equal ones the first."""
    best = None
    for s, n, p in rows:
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return best and (*best, 1000 * best[1] // best[2])


DIGESTS = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"),
           ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed) of every
    row: its runs in order of start and period, words counted from 0, and its
    words without those that a run repeats, joined by one space.

    Null text: empty, so no run. Repeated rows and null ids are rows like any
    other; an empty table gives an empty result; other columns are not read."""

    def run(texts: list[str]) -> dict:
        import pyarrow as pa

        w = Words(texts)
        runs = find_runs(w.hash | np.uint64(1), w.first)
        owner = np.searchsorted(w.first, runs[:, 0], side="right") - 1
        edge = np.searchsorted(owner, np.arange(len(texts) + 1))
        gone = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(gone[:-1]) == 0
        flat = pa.StructArray.from_arrays([pa.array(runs[:, 0] - w.first[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
        return {"runs": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), flat),
                "collapsed": [w.joined(i, kept[w.first[i] : w.first[i + 1]]).decode() for i in range(len(texts))]}

    return map_texts(id_text(docs, id_col, text_col), run,
                     [("runs", "array<struct<start:long,length:long,period:long>>"), ("collapsed", "string")])


def run_digests(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256) of every row: ``periodic_runs`` as digests, and the run
    of most periods (ties: smallest start, then period; nulls without a run).
    With ``plant`` the texts are first made periodic in part, by the crc32 of
    the decimal id (a null id counts as empty), as ``planted`` says.

    Nulls, repeats, empty tables and other columns as in ``periodic_runs``."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import functions as F

    from .common import map_batches
    from .ragged import batch_chunks

    src = id_text(docs, id_col, text_col)
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in batch_chunks(batch, "text"):
                seeds = part.column("seed").to_numpy(zero_copy_only=False) if plant else None
                made = _digests(texts, seeds)
                arrays = [pa.array(made[n], pa.int64() if kind == "long" else pa.string()) for n, kind in DIGESTS]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *[n for n, _ in DIGESTS]])

    return map_batches(src.withColumn("seed", seed), run, [("doc_id", src.schema["doc_id"].dataType), *DIGESTS])
