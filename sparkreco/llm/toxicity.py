"""Toxicity: a convolutional text classifier trained in numpy.

Words are lower-cased runs of letters, digits and bytes beyond ASCII. Each word's vector is the sum of rows of one hashed table: for the
whole word, its beginnings and its end, so that inflected and compounded words share what they have in common. Filters of several
widths run over the words of a text, the largest answer of each filter is kept, and a logistic layer reads those.
The rows start from log ratios of how often a feature occurs in either class; then all parts are trained by stochastic gradient
descent. Decision thresholds are calibrated by language on rows set aside from the training rows.

Defined cases: a null or empty text is scored as a text without words; every other text is scored whole, in stretches that
overlap by the width of the filters; a null or repeated id is carried along, a row is a row; labels, language, source and id are
never inputs of a score. Without any labelled row the score is 0.5 less a constant, the same for all. Other columns stay, whatever their
names (one with the score's name is replaced); an empty table gives no rows. A very long text is scored whole, in the memory of a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreco.llm import samples
from sparkreco.llm.blocks import text_bytes
from sparkreco.llm.hashing import LOWER, bytes_prefix, mix

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: Rows of the table, columns, filters of each width, widths, words and bytes of documents scored at once.
ROWS, DIM, FILTERS, WIDTHS, STRETCH, SLICE = 1 << 19, 4, 6, (1, 2, 3), 1 << 15, 1 << 19
#: Lengths in bytes of the beginnings and of the end that are features beside the whole word.
HEADS, TAIL = (3, 4, 5, 6), 5
N_FEATURES = 2 + len(HEADS)
#: A language's threshold needs so many rows of either class; its logit keeps within so much of the common cut, and is drawn to it as by so many rows.
LEAST_ROWS, FARTHEST, SHRINK = 30, 2.0, 60


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word (n, N_FEATURES), and where each document's words start, and the end."""
    data = LOWER[data]
    is_word = np.zeros(len(data) + 2, bool)
    is_word[1:-1] = _WORD[data]
    starts = np.flatnonzero(is_word[1:] & ~is_word[:-1])
    ends = np.flatnonzero(~is_word[1:] & is_word[:-1])
    # a word never reaches into the next document
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = np.unique(inner[is_word[inner] & is_word[inner + 1]])
    if len(inner):
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    prefix = bytes_prefix(data)
    cols = [prefix.spans(starts, ends)]
    for k, n in enumerate(HEADS):
        cols.append(mix(prefix.spans(starts, np.minimum(starts + n, ends)) + np.uint64(k + 1)))
    cols.append(mix(prefix.spans(np.maximum(ends - TAIL, starts), ends) + np.uint64(99)))
    rows = np.stack([c & np.uint64(ROWS - 1) for c in cols], axis=1).astype(np.int32) if len(starts) else np.zeros((0, N_FEATURES), np.int32)
    return rows, np.searchsorted(starts, offsets, side="left")


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of documents of about SLICE bytes, one document at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1))
        yield at, upto
        at = upto


@dataclass
class ToxicityModel:
    table: np.ndarray
    filters: dict[int, np.ndarray]
    filter_bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = self.table[rows[:, 0]]
        for k in range(1, N_FEATURES):
            x = x + self.table[rows[:, k]]
        return x

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(n, widths * FILTERS) before the ReLU; x has WIDTHS[-1] - 1 more vectors than answers are asked for."""
        n = len(x) - WIDTHS[-1] + 1
        cols = []
        for w in WIDTHS:
            part = x[:n] @ self.filters[w][:DIM]
            for j in range(1, w):
                part += x[j : j + n] @ self.filters[w][j * DIM : (j + 1) * DIM]
            cols.append(part + self.filter_bias[w])
        return np.concatenate(cols, axis=1)

    def pooled(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The largest answers of each document, over all of its words."""
        n_docs, pad = len(at) - 1, WIDTHS[-1] - 1
        out = np.zeros((n_docs, len(WIDTHS) * FILTERS), np.float32)
        # each document is followed by empty words, so that no filter reads across documents
        place = at[:-1] + pad * np.arange(n_docs)
        total = int(at[-1]) + pad * n_docs
        where = np.arange(int(at[-1])) + pad * np.repeat(np.arange(n_docs), np.diff(at))
        padded = np.full((total, N_FEATURES), -1, np.int32)
        padded[where] = rows
        for s in range(0, total, STRETCH):
            e = min(s + STRETCH, total)
            piece = padded[s : min(e + pad, total)]
            x = self.vectors(np.maximum(piece, 0)) * (piece[:, :1] >= 0)
            x = np.concatenate([x, np.zeros((e - s + pad - len(x), DIM), np.float32)]) if len(x) < e - s + pad else x
            y = self.responses(x.astype(np.float32))
            y[piece[: e - s, 0] < 0] = 0  # no filter starts beyond a text's last word, where it would read the next text
            first = int(np.searchsorted(place, s, side="right")) - 1
            last = int(np.searchsorted(place, e, side="left"))
            starts = np.maximum(place[first:last] - s, 0)
            out[first:last] = np.maximum(out[first:last], np.maximum.reduceat(y, starts, axis=0))
        return out

    def logits(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Of each document; some documents at a time, so that the work stays in the processor's cache."""
        out = [np.zeros(0)]
        for s, e in slices(offsets):
            rows, places = features(offsets[s : e + 1] - offsets[s], data[offsets[s] : offsets[e]])
            out.append(self.pooled(rows, places).astype(np.float64) @ self.out + self.out_bias - self.shift)
        return np.concatenate(out)


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


def train(sample: pd.DataFrame, epochs: int = 3, rate: float = 0.05, seed: int = 7) -> ToxicityModel:
    """sample: text, lang, label. A fifth of it is set aside for the thresholds."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (ROWS, DIM)).astype(np.float32)
    filters = {w: rng.normal(0, 0.3 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    bias = {w: np.full(FILTERS, -0.5, np.float32) for w in WIDTHS}
    model = ToxicityModel(table, filters, bias, np.full(len(WIDTHS) * FILTERS, 0.5), -1.0)
    y = sample["label"].to_numpy(int) if len(sample) else np.zeros(0, int)
    if len(set(y)) < 2:
        model.out[:] = 0
        return model
    aside = np.arange(len(y)) % 5 == 4
    offsets, data = _encode(sample["text"].tolist())
    # some documents at a time: hashing needs many times the memory of the text
    parts, at = [np.zeros((0, N_FEATURES), np.int32)], [np.zeros(1, np.int64)]
    for s, e in slices(offsets):
        own, places = features(offsets[s : e + 1] - offsets[s], data[offsets[s] : offsets[e]])
        parts.append(own)
        at.append(places[1:] + at[-1][-1])
    rows, at = np.concatenate(parts), np.concatenate(at)
    del parts
    # log ratios: how many documents of either class have a feature
    fit = ~aside
    counts = np.zeros((2, ROWS), np.int32)
    for i in np.flatnonzero(fit):
        counts[y[i], np.unique(rows[at[i] : at[i + 1]])] += 1
    f0, f1 = counts
    n1, n0 = max(1, (y[fit] == 1).sum()), max(1, (y[fit] == 0).sum())
    ratio = np.log((f1 + 1) / (n1 + 2)) - np.log((f0 + 1) / (n0 + 2)) - np.log((n0 + 2) / (n1 + 2))
    table[:, 0] += np.clip(ratio, -3, 6).astype(np.float32) / 2
    for w in WIDTHS:
        filters[w][np.arange(w) * DIM, 0] += 1.0 / w
    out, out_bias = model.out.copy(), model.out_bias
    groups = [np.flatnonzero(fit & (y == v)) for v in (0, 1)]
    pad = WIDTHS[-1] - 1
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        size = max(len(g) for g in groups)
        order = np.stack([rng.permutation(np.resize(rng.permutation(g), size)) for g in groups], 1).ravel()  # the classes in turn
        for i in order:
            own = rows[at[i] : at[i + 1]]
            if not len(own):
                continue
            x = np.zeros((len(own) + pad, DIM), np.float32)
            x[: len(own)] = model.vectors(own)
            resp = model.responses(x)
            best = resp.argmax(0)
            top = resp[best, np.arange(resp.shape[1])]
            pooled = np.maximum(top, 0)
            error = 1 / (1 + np.exp(-np.clip(pooled @ out + out_bias, -30, 30))) - y[i]
            if abs(error) < 1e-3:
                continue
            back = error * out * (top > 0)
            out -= step * (error * pooled + 1e-4 * out)
            out_bias -= step * error
            for q, w in enumerate(WIDTHS):
                for f in range(FILTERS):
                    g = back[q * FILTERS + f]
                    if g == 0:
                        continue
                    p = best[q * FILTERS + f]
                    window = x[p : p + w].ravel()
                    window = np.pad(window, (0, w * DIM - len(window)))
                    grad_x = g * filters[w][:, f]
                    filters[w][:, f] -= np.float32(step * np.clip(g, -1, 1)) * window * np.float32(0.1)
                    bias[w][f] -= np.float32(step * g * 0.1)
                    for j in range(w):
                        if p + j < len(own):
                            table[own[p + j]] -= np.float32(step * 0.2) * np.clip(grad_x[j * DIM : (j + 1) * DIM], -1, 1).astype(np.float32)
    model.out, model.out_bias = out, float(out_bias)
    found = model.logits(offsets, data)
    held = aside if (y[aside] == 1).sum() >= 5 else np.ones(len(y), bool)
    model.shift = _cut(found[held], y[held])
    langs = sample["lang"].to_numpy(object)
    for lang in {x for x in langs if x is not None}:
        own = held & (langs == lang)
        few = min((y[own] == 1).sum(), (y[own] == 0).sum())
        if few >= LEAST_ROWS:  # the fewer rows, the closer to the cut of all languages
            cut = np.clip(_cut(found[own], y[own]) - model.shift, -FARTHEST, FARTHEST) * few / (few + SHRINK)
            model.thresholds[lang] = float(1 / (1 + np.exp(-cut)))
    return model


def _cut(scores: np.ndarray, y: np.ndarray) -> float:
    """Midway in the widest gap among the cuts with the best balanced accuracy."""
    order = np.argsort(scores, kind="stable")
    s, t = scores[order], y[order]
    misses = np.concatenate([[0], np.cumsum(t)]) / max(1, t.sum())
    alarms = 1 - np.concatenate([[0], np.cumsum(1 - t)]) / max(1, (1 - t).sum())
    cost = misses + alarms
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 1500) -> ToxicityModel:
    """Train on up to per_class labelled documents of each class among those that allowed lets through."""
    return train(samples.labelled(docs, labels, "toxic", allowed, per_class))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a column `name` (0 to 1), which takes the place of one of that name. The model's size is fixed, so it is broadcast."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != name]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*[F.col(f"`{c}`") for c in names]).dtypes) + f", `{name}` double"
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_bytes(b.column(text_at))
            # the score also holds for the largest texts: the exponential stays finite
            score = 1 / (1 + np.exp(-np.clip(sent.value.logits(offsets, data), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*names, name])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def threshold(model: ToxicityModel, lang_col: str = "lang") -> Column:
    """The calibrated threshold for each row's language; 0.5 where the language has none."""
    found = F.lit(0.5)
    for lang, value in sorted(model.thresholds.items()):
        found = F.when(F.col(lang_col) == lang, F.lit(value)).otherwise(found)
    return found


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs below their language's threshold; columns as in docs."""
    least = threshold(model) if "lang" in docs.columns else F.lit(0.5)
    name = samples.unused("__toxicity", docs.columns)
    kept = score_toxicity(docs, model, name=name).filter(F.col(name) < least)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
