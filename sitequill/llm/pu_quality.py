"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled are rows of the web text as
it comes, whatever their labels. No negative label is used. The class prior
is estimated first: plain classifiers of positives against unlabelled rank
rows they were not learned from, and the least share of unlabelled rows that
any of their upper sets holds per positive bounds the prior. Then a logistic model minimises the
non-negative unbiased risk

    prior * E_pos[l(+g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)]).

Features are ratios of a text's characters, words and lines, computed for a
whole chunk of texts with array operations. The model is fitted on bounded
samples of rows (``SAMPLE_ROWS`` of either kind, least hash of the id first);
every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, id_text, map_texts
from .ragged import batch_chunks, segment_sums

#: Rows of either kind that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Rows whose crc32(id) modulo FOLDS is HELD_OUT are kept from learning.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
STEPS = 1500
LEARNING_RATE = 0.05
PENALTY = 1e-3
#: An upper set must hold this share of the positives to bound the prior.
LEAST_UPPER_SET = 0.3
#: Random splits of the rows that the prior is averaged over, folds of each,
#: and steps of the classifiers that rank them.
PRIOR_SPLITS, PRIOR_FOLDS, PRIOR_STEPS = 3, 5, 500

_KINDS = ("letter", "upper", "digit", "sentence", "quote", "symbol", "other", "wide")
_CLASS = np.full(256, _KINDS.index("other"), np.uint8)
_CLASS[[*range(0x61, 0x7B)]] = _KINDS.index("letter")
_CLASS[[*range(0x41, 0x5B)]] = _KINDS.index("upper")
_CLASS[[*range(0x30, 0x3A)]] = _KINDS.index("digit")
_CLASS[[*b".,;:?"]] = _KINDS.index("sentence")
_CLASS[[*b"'\"()-"]] = _KINDS.index("quote")
_CLASS[[*b"#*$%&|<>!@^~=_+{}[]\\/`"]] = _KINDS.index("symbol")
_CLASS[[*range(0x80, 0x100)]] = _KINDS.index("wide")
N_FEATURES = len(_KINDS) + 9
#: Place of the number of words among the features; it is no evidence itself.
N_WORDS = len(_KINDS)
#: Ratios of a text of n words are trusted by n / (n + EVIDENCE_WORDS): those
#: of a very short text say little.
EVIDENCE_WORDS = 20


def features(texts: list[str]) -> np.ndarray:
    """(texts, N_FEATURES) ratios; all zero for a text without words."""
    from .substring_dedup import Words

    w = Words(texts)
    raw = np.frombuffer(w.raw, np.uint8)
    size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
    edge = np.concatenate([[0], np.cumsum(size)])
    n = w.count.astype(float)
    some = np.maximum(n, 1)
    kind = _CLASS[raw]
    solid = raw > 0x20
    total = np.maximum(segment_sums(solid, edge), 1)
    columns = [segment_sums((kind == k) & solid, edge) / total for k in range(len(_KINDS))]
    length = (w.end - w.start).astype(float)
    owner = np.repeat(np.arange(len(texts)), w.count)
    columns.append(n)
    columns.append(np.bincount(owner, length, len(texts)) / some)
    columns.append(np.bincount(owner, length == 1, len(texts)) / some)
    columns.append(np.bincount(owner, length > 20, len(texts)) / some)
    pair = np.zeros(len(owner), bool)
    pair[1:] = (owner[1:] == owner[:-1]) & (w.hash[1:] == w.hash[:-1])
    columns.append(np.bincount(owner, pair, len(texts)) / some)
    # Distinct words shrink with length even in good text; compare with a power of it.
    columns.append(_distinct(owner, w.hash, len(texts)) / some**0.9)
    shifted = w.hash * np.uint64(0x9E3779B97F4A7C15)
    shifted[:-1] += w.hash[1:]
    columns.append(_distinct(owner, shifted, len(texts)) / some)
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.float64, len(lines))
    distinct = np.fromiter((len(set(x)) for x in lines), np.float64, len(lines))
    columns.append(1 - distinct / np.maximum(n_lines, 1) * (n_lines > 0))
    columns.append(n_lines / some)
    return np.where(n[:, None] > 0, np.stack(columns, axis=1), 0.0)


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o, new, n)


class Model(NamedTuple):
    """Logistic model over standardised, clipped features and their squares,
    drawn to the mean for short texts."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) * (x[:, N_WORDS] / (x[:, N_WORDS] + EVIDENCE_WORDS))[:, None]
        z[:, N_WORDS] = 0
        return np.hstack([z, z * z / 6, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, size: int, steps: int = STEPS) -> np.ndarray:
    """Adam from zero, whole samples at every step; deterministic."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - LEARNING_RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """Upper bound of the share of positives among the unlabelled.

    The unlabelled are positives and others, so any set of texts holds at
    least prior times as large a share of the unlabelled as of the positives;
    the upper sets of a classifier of the two come close to equality. Each
    fold is ranked by a classifier learned from the other folds, and the shares
    of its upper sets are averaged over the folds of ``PRIOR_SPLITS`` random
    splits before the least ratio is taken: that of one ranking alone turns on
    the order of the rows and, being the least of many noisy ones, falls short."""
    rng = np.random.default_rng(seed)
    shares = []
    for _ in range(PRIOR_SPLITS):
        fold_p, fold_u = (rng.permutation(len(x)) % PRIOR_FOLDS for x in (positive, unlabelled))
        for k in range(PRIOR_FOLDS):
            parts = positive[fold_p == k], unlabelled[fold_u == k], positive[fold_p != k], unlabelled[fold_u != k]
            if all(map(len, parts)):
                shares.append(_upper_shares(*parts))
    if not shares:
        return 0.5
    of_p, of_u = np.mean(shares, axis=0)
    return float(np.clip((of_u / of_p).min(), 0.05, 0.95))


def _upper_shares(positive, unlabelled, other_positive, other_unlabelled) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the positives and of the unlabelled in upper sets of a
    classifier learned from the others."""

    def gradient(w):
        p, u = _sigmoid(other_positive @ w), _sigmoid(other_unlabelled @ w)
        return -other_positive.T @ (1 - p) / len(p) / 2 + other_unlabelled.T @ u / len(u) / 2

    w = _descend(gradient, positive.shape[1], PRIOR_STEPS)
    p, u = np.sort(positive @ w), np.sort(unlabelled @ w)
    levels = np.quantile(p, np.linspace(0, 1 - LEAST_UPPER_SET, 50))
    return 1 - np.searchsorted(p, levels) / len(p), 1 - np.searchsorted(u, levels) / len(u)


def risks(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Unbiased estimates of the positives' and of the negatives' part of the
    logistic risk; the second may fall below zero."""
    zp, zu = positive @ w, unlabelled @ w
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())


def risk_gradient(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Step of the non-negative estimator: the gradient of the whole risk, or,
    where the negatives' part falls below zero, back up along that part."""
    zp, zu = positive @ w, unlabelled @ w
    up = -prior * (positive.T @ (1 - _sigmoid(zp))) / len(zp)
    down = unlabelled.T @ _sigmoid(zu) / len(zu) - prior * (positive.T @ _sigmoid(zp)) / len(zp)
    return up + down if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean() else -down


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 0) -> Model:
    """Minimise the non-negative unbiased risk. Without positives or without
    unlabelled rows every text scores one half."""
    every = np.vstack([positive, unlabelled])
    if not len(positive) or not len(unlabelled):
        n = N_FEATURES
        return Model(np.zeros(n), np.ones(n), np.zeros(2 * n + 1), 0.5)
    empty = Model(every.mean(axis=0), every.std(axis=0) + 1e-6, np.zeros(0), 0.0)
    p, u = empty.inputs(positive), empty.inputs(unlabelled)
    prior = estimate_prior(p, u, seed) if prior is None else prior
    return empty._replace(weights=_descend(lambda w: risk_gradient(w, p, u, prior), p.shape[1]), prior=prior)


def _feature_rows(rows: DataFrame) -> np.ndarray:
    def run(texts: list[str]) -> dict:
        return {"x": list(features(texts))}

    got = sorted(map_texts(rows, run, [("x", "array<double>")]).select("doc_id", "x").collect(), key=lambda r: r["doc_id"])
    return np.array([r["x"] for r in got], np.float64).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on rows outside the held-out fold: up to ``sample_rows`` rows with
    label 1 as positives and up to as many rows, labelled or not, as
    unlabelled. Which rows those are is settled on ids; only their texts are
    fetched, one of each id however many rows share it. Labels without a row, null labels and null ids are ignored."""
    learn = id_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & (fold_remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(label_id).alias("doc_id")).distinct()
    ids = learn.select("doc_id").distinct()

    def texts(chosen: DataFrame) -> np.ndarray:
        first = chosen.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample_rows)
        # At most sample_rows ids, and one row of each: rows that share an id are
        # combined before they are moved.
        rows = learn.join(F.broadcast(first), "doc_id", "left_semi")
        return _feature_rows(rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    return fit(texts(ids.join(trusted, "doc_id", "left_semi")), texts(ids))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have no words and are scored by all-zero features.
    Repeated rows and null ids are scored like any other row; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(texts: list[str]) -> dict:
        return {"score": Model(*shared.value).score(features(texts))}

    out = map_texts(id_text(docs, id_col, text_col), run, [("score", "double")])
    return out.select("doc_id", (fold_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more. Columns stay as
    they are; rows are not moved."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = Model(*shared.value)
        for batch in batches:
            for part, texts in batch_chunks(batch, text_col):
                yield part.filter(pa.array(good.score(features(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
