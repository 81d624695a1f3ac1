"""Classifiers against plain versions, pipeline stages on odd rows and empty tables."""

import math
import random
import re

import numpy as np
import pytest

from sparkreco.llm import quality, toxicity

TEXTS = ["", "a", "idiot", "You IDIOT, go away!", "x\n\nx\nx\n", "\n", "no end no end no end", "  spaced\tout \x0b words  ", "größe ß 中文 中文", "one " * 700, "line\n" * 50 + "last"]


def _random_model():
    rng = np.random.default_rng(3)
    filters = {w: rng.normal(size=(w * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}
    bias = {w: rng.normal(size=toxicity.FILTERS).astype(np.float32) for w in toxicity.WIDTHS}
    table = rng.normal(size=(toxicity.ROWS, toxicity.DIM)).astype(np.float32)
    return toxicity.ToxicityModel(table, filters, bias, rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS), 0.3, 0.1)


def _plain_logit(model, text):
    """One word, one filter, one start at a time."""
    vectors = []
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
        rows, _ = toxicity.features(np.array([0, len(word)]), np.frombuffer(word, np.uint8))
        vectors.append([sum(float(model.table[r, d]) for r in rows[0]) for d in range(toxicity.DIM)])
    logit = model.out_bias - model.shift
    for q, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for start in range(len(vectors)):
                answer = float(model.filter_bias[width][f])
                for j, v in enumerate(vectors[start : start + width]):
                    answer += sum(v[d] * float(model.filters[width][j * toxicity.DIM + d, f]) for d in range(toxicity.DIM))
                best = max(best, answer)
            logit += best * float(model.out[q * toxicity.FILTERS + f])
    return logit


@pytest.mark.parametrize("stretch", [1 << 15, 5])
def test_toxicity_against_a_plain_convolution(monkeypatch, stretch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    model = _random_model()
    assert np.allclose(model.logits(*toxicity._encode(TEXTS)), [_plain_logit(model, t) for t in TEXTS], rtol=1e-4, atol=1e-3)


def _plain_shares(text):
    data = text.encode()
    out = [0.0] * quality.N_FEATURES
    for c in data:
        out[quality._CLASS[c]] += 1 / len(data)
    out[: quality.N_CLASSES] = [math.sqrt(x) for x in out[: quality.N_CLASSES]]
    for k, pieces in enumerate((data.split(), re.findall(rb"[^\n]*\n|[^\n]+", data))):
        n = max(1, len(pieces))
        again = sum(a == b for a, b in zip(pieces, pieces[1:], strict=False))
        out[quality.N_CLASSES + 4 * k : quality.N_CLASSES + 4 * k + 4] = [math.log1p(len(pieces)), math.log1p(sum(map(len, pieces)) / n), len(set(pieces)) / n, again / n]
    out[-1] = math.log1p(len(data))
    return out


def test_shares_against_a_plain_count():
    assert np.allclose(quality._features(TEXTS), [_plain_shares(t) for t in TEXTS])


def _plain_risk(weights, positive, unlabelled, prior):
    """What a step makes less: the non-negative risk, or, where its negative part is below 0, this part turned around."""
    w1, b1, w2, b2 = weights
    mean = lambda xs, sign: sum(1 / (1 + math.exp(-sign * float(np.tanh(x @ w1 + b1) @ w2 + b2[0]))) for x in xs) / len(xs)
    negative = mean(unlabelled, 1) - prior * mean(positive, 1)
    decay = 0.5e-4 * float((w1**2).sum() + (w2**2).sum())
    return decay + (prior * mean(positive, -1) + negative if negative >= 0 else -negative)


@pytest.mark.parametrize("prior", [0.3, 0.98])
def test_quality_steps_against_slopes_of_the_plain_risk(prior):
    rng = np.random.default_rng(4)
    positive, unlabelled = rng.normal(1, 1, (7, quality.N_FEATURES)), rng.normal(-1 if prior > 0.9 else 0, 1, (9, quality.N_FEATURES))
    start = quality.train(positive, unlabelled, prior, hidden=2, steps=0)
    xs = [np.clip((x - start.mean) / start.scale, -8, 8) for x in (positive, unlabelled)]
    weights = [w.astype(float).copy() for w in start.weights]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    turned = False
    for t in range(1, 6):
        slopes = []
        for w in weights:
            slope = np.zeros_like(w)
            for at in np.ndindex(w.shape):
                kept, ends = w[at], []
                for d in (1e-5, -1e-5):
                    w[at] = kept + d
                    ends.append(_plain_risk(weights, *xs, prior))
                w[at] = kept
                slope[at] = (ends[0] - ends[1]) / 2e-5
            slopes.append(slope)
        g = [np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3][0] for x in xs]
        turned |= (1 / (1 + np.exp(-g[1]))).mean() < prior * (1 / (1 + np.exp(-g[0]))).mean()
        for k, slope in enumerate(slopes):
            m[k], v[k] = 0.9 * m[k] + 0.1 * slope, 0.999 * v[k] + 0.001 * slope**2
            weights[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
        got = quality.train(positive, unlabelled, prior, hidden=2, steps=t)
        assert all(np.allclose(a, b, atol=2e-5) for a, b in zip(got.weights, weights, strict=True)), t
    assert turned == (prior > 0.9)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["toxicity", "quality_score", "block", "payload", "kept", "ids", "label", "score", "__null", "__id", "__text", "__flag", "__toxicity", "__leaks"]


def _tables(spark, folder, items):
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_of_no_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    _tables(spark, tmp_path, [])
    docs = spark.createDataFrame([], SCHEMA)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
        assert k == len(pipeline.STAGES) - 1 or out.columns == docs.columns, name


def test_stages_on_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    _tables(spark, tmp_path, [(1, None), (2, ""), (3, "what is the tallest of the seven hills near the old harbour town today")])
    rng = random.Random(8)
    long = " ".join(rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(1000)) for _ in range(60_000))
    rows = [(1, "first words of some text that is plain"), (2, None), (2, None), (3, ""), (None, "a text without an id"), (None, None), (4, long), (5, "   \n\t "), (6, "twice the very same row"), (6, "twice the very same row")]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *CLASHING) for i, t in rows], f"{SCHEMA}, {', '.join(f'{c} string' for c in CLASHING)}")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k == len(pipeline.STAGES) - 1:
            assert out.count() == len(rows)
            continue
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[c] == c for r in got for c in CLASHING), name
        ids = {r["doc_id"] for r in got}
        assert name == "toxicity" or {1, 4} <= ids, name
        assert name == "toxicity" or [r["text"] for r in got if r["doc_id"] == 4] == [long], name
        assert name in ("toxicity", "suffix_dedup") or len([1 for r in got if r["text"] is None]) == 3, name
