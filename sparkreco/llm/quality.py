"""Quality: positive-unlabelled learning on the shape of a text.

A small network is trained in numpy on trusted positives and on unlabelled web text, minimising the non-negative unbiased
risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). The class prior is estimated from positives and
unlabelled texts alone: networks trained on halves rank the other halves, and the prior is the least ratio of their shares above a score.
Rows labelled 0 are not looked at. Inputs are shares of byte classes and of repeated words and lines; labels, language,
source and id are never inputs. The output is shifted so that the network's own cut gets the score decide_at.

Defined cases: a null or empty text has all shares zero and is scored like any other; texts are read whole; a null or repeated id is
carried along, a row is a row; a column quality_score takes the place of one of that name; with no trusted positives or no unlabelled
text all scores are alike; other columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreco.llm import samples
from sparkreco.llm.blocks import text_bytes
from sparkreco.llm.hashing import bytes_prefix, word_spans
from sparkreco.llm.toxicity import slices

#: Byte classes: each ASCII byte beyond letters and digits alone; lower case, upper case, digits, beyond ASCII, controls together.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_OTHERS = [c for c in range(32, 127) if not chr(c).isalnum()]
_CLASS[_OTHERS] = np.arange(5, 5 + len(_OTHERS))
_CLASS[10] = 5 + len(_OTHERS)
N_CLASSES = 6 + len(_OTHERS)
N_FEATURES = N_CLASSES + 9


def _shares(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, N_FEATURES))
    out[:, :N_CLASSES] = np.sqrt(np.bincount(doc * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(sizes, 1)[:, None])

    def repeats(starts: np.ndarray, ends: np.ndarray, at: int) -> None:
        """Of the pieces: how many there are, their length, and the shares that are new in their text, and that repeat the piece before."""
        whose = np.searchsorted(offsets, starts, side="right") - 1
        keys = prefix.spans(starts, ends)
        count = np.bincount(whose, minlength=n)
        some = np.maximum(count, 1)
        out[:, at] = np.log1p(count)
        out[:, at + 1] = np.log1p(np.bincount(whose, ends - starts, minlength=n) / some)
        order = np.lexsort((keys, whose))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (whose[order][1:] != whose[order][:-1])
        out[:, at + 2] = np.bincount(whose[order][new], minlength=n) / some
        same = (keys[1:] == keys[:-1]) & (whose[1:] == whose[:-1])
        out[:, at + 3] = np.bincount(whose[1:][same], minlength=n) / some

    prefix = bytes_prefix(data)
    starts, ends = _within(*word_spans(data), offsets, data)
    repeats(starts, ends, N_CLASSES)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][sizes > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.concatenate([starts[1:], [len(data)]])[: len(starts)]
    filled = ends > starts
    repeats(starts[filled], ends[filled], N_CLASSES + 4)
    out[:, N_CLASSES + 8] = np.log1p(sizes)
    return out


def _within(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut at the ends of documents, which may have no space between them."""
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    k = np.searchsorted(starts, inner, side="right") - 1
    cut = inner[(k >= 0) & (starts[np.maximum(k, 0)] < inner) & (ends[np.maximum(k, 0)] > inner)] if len(starts) else inner[:0]
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


def shares(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    parts = [_shares(offsets[s : e + 1] - offsets[s], data[offsets[s] : offsets[e]]) for s, e in slices(offsets)]
    return np.concatenate([np.zeros((0, N_FEATURES)), *parts])


@dataclass
class QualityModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    decide_at: float = 0.5

    def margins(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x) + np.log(self.decide_at / (1 - self.decide_at)), -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 400, rate: float = 0.01, seed: int = 5) -> QualityModel:
    """Adam on the whole sample. Where the negative part of the risk falls below zero, its gradient is turned around."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, N_FEATURES))
    model = QualityModel(prior, both.mean(0), both.std(0) + 0.02, [rng.normal(0, 0.3, (N_FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)])
    if not len(positive) or not len(unlabelled):
        model.weights[2][:] = 0
        return model
    xs = [np.clip((x - model.mean) / model.scale, -8, 8) for x in (positive, unlabelled)]
    m, v = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for t in range(1, steps + 1):
        w1, b1, w2, b2 = model.weights
        hs = [np.tanh(x @ w1 + b1) for x in xs]
        gs = [h @ w2 + b2[0] for h in hs]
        # sigmoid loss: l+(g) = s(-g), l-(g) = s(g), both with the slope s(g) * s(-g)
        ss = [1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in gs]
        slopes = [s * (1 - s) / len(s) for s in ss]
        negative = ss[1].mean() - prior * ss[0].mean()
        if negative >= 0:
            d = [-prior * slopes[0] - prior * slopes[0], slopes[1]]
        else:
            d = [prior * slopes[0], -slopes[1]]
        grads = [1e-4 * w1, np.zeros_like(b1), 1e-4 * w2, np.zeros_like(b2)]
        for x, h, e in zip(xs, hs, d, strict=True):
            back = np.outer(e, w2) * (1 - h * h)
            for k, g in enumerate((x.T @ back, back.sum(0), h.T @ e, np.array([e.sum()]))):
                grads[k] = grads[k] + g
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            model.weights[k] = model.weights[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    return model


def _features(texts: list[str]) -> np.ndarray:
    return shares(*text_bytes(pa.array(texts, pa.string())))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5) -> float:
    """The share of positives among the unlabelled: a ranking of either half by a network that learned from the other.

    Above a score where all are positives, the unlabelled share is the prior times the positives' share; elsewhere it is more. So the least
    ratio counts, among the scores that `least` of the positives reach: above higher ones stand too few.
    """
    scores: list[list[np.ndarray]] = [[], []]
    for half in (0, 1):
        ranking = train(positive[half::2], unlabelled[half::2], 0.5)
        for k, x in enumerate((positive, unlabelled)):
            scores[k].append(ranking.margins(x[1 - half :: 2]))
    p, u = (np.sort(np.concatenate(x)) for x in scores)
    if not len(p) or not len(u):
        return 0.5
    cuts = np.unique(p[: max(1, int(len(p) * (1 - least)))])
    above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (p, u))
    return float(np.clip((above_u / above_p).min(), 0.02, 0.98))


def fit_quality(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 1500, unlabelled: int = 3000, decide_at: float = 0.5) -> QualityModel:
    """Trusted positives: up to per_class rows labelled 1 among the allowed; about unlabelled texts of whatever label."""
    positive = _features(samples.labelled(docs, labels, "quality", allowed, per_class, (1,))["text"].tolist())
    mixed = _features(samples.unlabelled(docs, allowed, unlabelled)["text"].tolist())
    model = train(positive, mixed, estimate_prior(positive, mixed))
    model.decide_at = decide_at
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with a column quality_score (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "quality_score"]
    src = docs.select(*[F.col(f"`{c}`") for c in names])
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.scores(shares(*text_bytes(b.column(text_at)))), pa.float64())], [*names, "quality_score"])

    return src.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in src.dtypes) + ", quality_score double")
