"""Language identification by segmentation-marginalised unigram models.

The vocabulary of pieces is fixed and public; what is learned per language is
one probability per piece. A word's probability is the sum over all ways to
cut it into pieces, found by the forward algorithm; a text's is the product
over its words. Piece probabilities are expected piece counts over all
segmentations (forward-backward), starting from equal probabilities.

Training counts cover every row of the training fold: tasks add up expected
counts of their rows and emit one row per language and piece, so what is
shuffled and collected is bounded by languages times vocabulary.
Characters outside the vocabulary have one small probability in every
language and so do not speak for any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fold_remainder, id_text, map_batches, map_texts
from .ragged import batch_chunks, disjoint_hash, prefix_sums, ragged_index, segment_sums, slice_hash

#: Characters of text handled at once.
CHUNK = 1 << 21
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
#: Words up to this length (with the mark) need no rescaling: UNKNOWN to this
#: power is still a normal double.
UNSCALED_WIDTH = 40
#: Added to each expected count, in counts.
SMOOTHING = 0.1
#: Words whose scores a worker remembers before it starts afresh.
CACHE_WORDS = 600_000
#: Rows whose crc32(id) modulo this is 0 are held out.
FOLDS = 5
#: Of the median gain over the background that a language's training rows have,
#: the share that a text must have to count as written in it.
GAIN_SHARE = 0.05
UNDETERMINED = "und"
MARK = "▁"


@lru_cache(maxsize=2)
def pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the word mark in front."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) and p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha()):
            found.append(p)
    return found


class Lattice:
    """All places of pieces in a batch of words."""

    def __init__(self, path: str) -> None:
        from .bpe import code_values

        own = pieces(path)
        self.values = code_values()
        self.longest = max(map(len, own))
        cp = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
        n = np.fromiter(map(len, own), np.int64, len(own))
        sums, down = prefix_sums(self.values[cp])
        keys = slice_hash(sums, down, np.cumsum(n) - n, np.cumsum(n))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.size = len(own)

    def find(self, cp: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """For each length 1.. the piece that starts at each position, or -1.

        ``end`` is the end of the word of each position."""
        sums, down = prefix_sums(self.values[cp])
        at = np.arange(len(cp))
        out = []
        for length in range(1, self.longest + 1):
            here = at[at + length <= end] if length == 1 else here[here + length <= end[here]]
            piece = np.full(len(cp), -1, np.int32)
            if len(here):
                h = slice_hash(sums, down, here, here + length)
                slot = np.minimum(np.searchsorted(self.keys, h), self.size - 1)
                hit = self.keys[slot] == h
                piece[here[hit]] = self.ids[slot[hit]]
            out.append(piece)
        return out


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _words(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined lower-case text, word starts, word ends, word keys, offsets by text)."""
    from .bpe import code_values

    folded = [t.lower() for t in texts]
    big = "".join(folded)
    cp = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    n = np.fromiter(map(len, folded), np.int64, len(folded))
    begin = np.cumsum(n) - n
    letter = letters()[cp]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = begin[(n > 0)]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    final = (begin + n - 1)[n > 0]
    last[final] = letter[final]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.append(np.searchsorted(s, begin), len(s))
    return big, s, e, disjoint_hash(code_values()[cp], s, e), offsets


def _marked(big: str, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with the word mark in front, and lengths."""
    cp = np.frombuffer(big.encode("utf-32-le"), np.uint32)
    n = e - s
    at = np.cumsum(n + 1) - (n + 1)
    out = np.full(int((n + 1).sum()), ord(MARK), np.uint32)
    out[ragged_index(at + 1, n)] = cp[ragged_index(s, n)]
    return out, n + 1


def _by_length(sizes: np.ndarray, columns: int = 1) -> Iterator[np.ndarray]:
    """Groups of words of like length (longest at most twice the shortest)
    whose tables of ``columns`` values a character stay small."""
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        top = max(8, 2 * int(sizes[order[i]]))
        j = int(np.searchsorted(sizes[order], top, side="right"))
        while i < j:
            step = max(1, (1 << 20) // (top * columns))
            yield order[i : min(i + step, j)]
            i = min(i + step, j)


def _forward(found, start, size, model, longest) -> np.ndarray:
    """log of the summed probability of each word, for each column of ``model``."""
    n, width = len(start), int(size.max())
    langs, last = model.shape[1], len(found[0]) - 1
    alpha = np.zeros((width + 1, n, langs))
    alpha[0] = 1
    scale = np.zeros((n, langs))
    total = np.zeros((n, langs))
    for t in range(1, width + 1):
        live = size >= t
        for length in range(1, min(t, longest) + 1):
            piece = np.where(live, found[length - 1][np.minimum(start + t - length, last)], -1)
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                alpha[t, hit] += alpha[t - length, hit] * model[piece[hit]]
            if length == 1:
                lost = np.flatnonzero(live & (piece < 0))
                alpha[t, lost] += alpha[t - 1, lost] * UNKNOWN
        done = np.flatnonzero(size == t)
        total[done] = np.log(np.maximum(alpha[t, done], 1e-300)) + scale[done]
        if t % 8 == 0:  # keep the values that are still read away from zero
            live_values = alpha[max(0, t - longest + 1) : t + 1]
            top = np.maximum(live_values.max(axis=0), 1e-300)
            live_values /= top
            scale += np.log(top)
    return total


def word_scores(big, s, e, lattice: Lattice, model: np.ndarray) -> np.ndarray:
    """(words, languages) log probability of each word [s, e) of ``big``."""
    cp, size = _marked(big, s, e)
    start = np.cumsum(size) - size
    found = lattice.find(cp, np.repeat(start + size, size))
    out = np.zeros((len(s), model.shape[1]))
    for group in _by_length(size, model.shape[1]):
        out[group] = _forward(found, start[group], size[group], model, lattice.longest)
    return out


def expected_counts(big, s, e, weight: np.ndarray, lattice: Lattice, model: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of the words,
    each word weighted; ``model`` is one probability per piece."""
    cp, size = _marked(big, s, e)
    start = np.cumsum(size) - size
    found = lattice.find(cp, np.repeat(start + size, size))
    counts = np.zeros(lattice.size)
    for group in _by_length(size, lattice.longest):  # a table for each length of piece
        _add_expected(found, start[group], size[group], weight[group], model, lattice.longest, counts)
    return counts


def _add_expected(found, start, size, weight, model, longest, counts) -> None:
    n, width = len(start), int(size.max())
    last = len(found[0]) - 1
    grid = start[:, None] + np.arange(width)[None, :]
    inside = np.arange(width)[None, :] < size[:, None]
    grid = np.minimum(grid, last)
    arcs = []  # by length: probability of the piece at (word, position), its id
    for length in range(1, min(width, longest) + 1):
        piece = np.where(inside, found[length - 1][grid], -1)
        p = np.where(piece >= 0, model[piece], 0.0)
        if length == 1:
            p = np.where(inside & (piece < 0), UNKNOWN, p)
        arcs.append((piece, p))
    # Forward and backward values. Long words are rescaled at every step (logs
    # of the scales in log_a and log_b); short ones cannot underflow.
    scaled = width > UNSCALED_WIDTH
    ones = np.ones(n)
    alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    log_a, log_b = np.zeros((width + 1, n if scaled else 1)), np.zeros((width + 2, n if scaled else 1))
    alpha[0] = 1
    for t in range(1, width + 1):
        for length in range(1, min(t, longest) + 1):
            step = alpha[t - length] * arcs[length - 1][1][:, t - length]
            alpha[t] += step * np.exp(log_a[t - length] - log_a[t - 1]) if scaled else step
        if scaled:
            top = np.where(alpha[t] > 0, alpha[t], ones)
            alpha[t] /= top
            log_a[t] = log_a[t - 1] + np.log(top)
    for t in range(width, -1, -1):
        beta[t] = size == t
        for length in range(1, min(width - t, longest) + 1):
            step = arcs[length - 1][1][:, t] * beta[t + length]
            beta[t] += step * np.exp(log_b[t + length] - log_b[t + 1]) if scaled else step
        if scaled:
            top = np.where(beta[t] > 0, beta[t], ones)
            beta[t] /= top
            log_b[t] = log_b[t + 1] + np.log(top)
    whole = alpha[size, np.arange(n)]
    for length, (piece, p) in enumerate(arcs, 1):
        w, t = np.nonzero(piece >= 0)
        if len(w):
            share = alpha[t, w] * beta[t + length, w] * p[w, t] / whole[w]
            if scaled:
                share *= np.exp(log_a[t, w] + log_b[t + length, w] - log_a[size[w], w])
            counts += np.bincount(piece[w, t], weights=share * weight[w], minlength=len(counts))


_LATTICES: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def piece_counts(training: DataFrame, vocabulary_path: str) -> DataFrame:
    """(lang, piece, n): expected piece counts over all rows of (text, lang).

    A task emits one row per language and piece for all of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary_path)
        equal = np.full(lattice.size, 1 / lattice.size)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                for _, texts in batch_chunks(own, "text", CHUNK):
                    big, s, e, keys, _ = _words(texts)
                    _, where, n = np.unique(keys, return_index=True, return_counts=True)
                    if len(where):
                        got = expected_counts(big, s[where], e[where], n.astype(float), lattice, equal)
                        total[lang] = total.get(lang, 0.0) + got
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "piece", "n"])

    tasks = map_batches(training.select("text", "lang"), run, [("lang", "string"), ("piece", "int"), ("n", "double")])
    return tasks.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Languages and, for each, the probability of every piece."""

    def __init__(self, langs: list[str], probabilities: np.ndarray) -> None:
        self.langs, self.probabilities = langs, probabilities


def train(docs: DataFrame, vocabulary_path: str, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a label whose crc32(id) modulo ``folds`` is not 0.

    What reaches the driver is at most languages times vocabulary counts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold_remainder(F.col("doc_id"), folds) != 0))
    got = piece_counts(rows, vocabulary_path).toPandas()
    langs = sorted(set(got["lang"]))
    counts = np.full((len(pieces(vocabulary_path)), len(langs)), SMOOTHING)
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        # Sums of doubles depend on task order in their last bits; models must not.
        counts[own["piece"].to_numpy(), i] += np.round(own["n"].to_numpy(), 6)
    return Model(langs, counts / counts.sum(axis=0, keepdims=True))


class Scorer:
    """Scores words once per worker, within a bounded cache: by each language
    and, in the last column, by a background in which all pieces are equal."""

    def __init__(self, path: str, model: Model) -> None:
        self.lattice, self.model = _lattice(path), model
        equal = np.full((self.lattice.size, 1), 1 / self.lattice.size)
        self.columns = np.hstack([model.probabilities, equal])
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, self.columns.shape[1]))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability by text and column, characters of words by text,
        each word's mark included)."""
        if len(self.keys) > CACHE_WORDS:
            self._clear()
        big, s, e, keys, offsets = _words(texts)
        n = segment_sums(e - s + 1, offsets)
        out = np.zeros((len(texts), self.columns.shape[1]))
        if not len(keys):
            return out, n
        unique, where, back = np.unique(keys, return_index=True, return_inverse=True)
        new = ~np.isin(unique, self.keys)
        if new.any():
            scored = word_scores(big, s[where[new]], e[where[new]], self.lattice, self.columns)
            at = np.searchsorted(self.keys, unique[new])
            self.keys = np.insert(self.keys, at, unique[new])
            self.scores = np.insert(self.scores, at, scored, axis=0)
        each = self.scores[np.searchsorted(self.keys, unique)][back]
        filled = n > 0
        out[filled] = np.add.reduceat(each, offsets[:-1][filled], axis=0)
        return out, n


_SCORERS: dict[str, Scorer] = {}


def _scorer(path: str, name: str, model: Model) -> Scorer:
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(path, model)
    return _SCORERS[name]


def _predict(texts: list[str], path: str, name: str, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and gain of each text. The gain is the log
    probability per character by the best language less that by the background:
    above zero where the language explains the text's pieces at all."""
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    scored, n = _scorer(path, name, model).texts(texts)
    logs, background = scored[:, :-1], scored[:, -1]
    best = logs.argmax(axis=1)
    top = logs.max(axis=1, keepdims=True)
    score = np.where(n > 0, 1 / np.exp(logs - top).sum(axis=1), 0.0)
    return ([model.langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), n.tolist(), strict=True)], score,
            (top[:, 0] - background) / np.maximum(n, 1))


def predict(docs: DataFrame, model: Model, vocabulary_path: str, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    ``score`` is the posterior of the predicted language at equal priors. A
    null text or one without a letter is ``und`` with score 0, and so is
    everything when no language was learned. Ties go to the first language by
    name. Repeated rows and null ids (held_out by the empty id) are rows like
    any other; an empty table gives an empty result; other columns are not
    read.
    """
    name = _model_name(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict:
        langs, score, _ = _predict(texts, vocabulary_path, name, shared.value)
        return {"lang_pred": langs, "score": score}

    out = map_texts(id_text(docs, id_col, text_col), run, [("lang_pred", "string"), ("score", "double")], CHUNK)
    return out.select("doc_id", (fold_remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, vocabulary_path: str, least: float = 0.5, share: float = GAIN_SHARE, folds: int = FOLDS,
                    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is determined: with a posterior of
    ``least`` or more, and a gain over the background of ``share`` of the
    median gain of that language's training rows or more.

    The posterior only compares the learned languages and nears 1 for any text
    of some words; the gain tells noise and languages that were not learned.
    Null and letterless texts go, and all rows when no language was learned.
    Repeated rows are judged alike; an empty table stays empty. Texts are
    scored once, and written with their scores before the medians are taken."""
    name = _model_name(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in batch_chunks(batch, text_col, CHUNK):
                found = _predict(texts, vocabulary_path, name, shared.value)
                row = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays([row, *map(pa.array, found)], names=["row", "found", "score", "gain"])

    scored = cut_lineage(map_batches(docs, run, [("row", docs.schema), ("found", "string"), ("score", "double"), ("gain", "double")]))
    label = F.col(f"row.`{lang_col}`").cast("string")
    training = scored.where(label.isNotNull() & (F.col("found") == label) & (fold_remainder(F.col(f"row.`{id_col}`"), folds) != 0))
    # One row a learned language.
    medians = training.groupBy("found").agg(F.percentile_approx("gain", 0.5, 10_000).alias("median")).collect()
    bounds = [F.when(F.col("found") == r["found"], F.lit(share * r["median"])) for r in medians]
    enough = (F.col("gain") >= F.coalesce(*bounds, F.lit(0.0))) & (F.col("score") >= least)
    return scored.where((F.col("found") != UNDETERMINED) & enough).select("row.*")


def _model_name(model: Model) -> str:
    import hashlib

    return hashlib.sha256(repr(model.langs).encode() + model.probabilities.tobytes()).hexdigest()
