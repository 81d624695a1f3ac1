"""LM scoring by a log-bilinear model trained with noise-contrastive estimation.

Outcomes of the network are the most frequent words of the training texts, the end of a text, and classes of all other
words by their last letters. The two outcomes before a token predict its outcome: each has a vector, a diagonal matrix for its distance
weighs it, and the sum is compared with the vectors of all outcomes. The vectors are trained in numpy by noise-contrastive
estimation on ALL training texts: from a start that a bounded sample gives, each task goes on over the tokens of its own blocks, and the
tasks' networks are averaged by their numbers of tokens, some at a time. The normalisers of all pairs of contexts then come from
batched matrix products, so every probability is normalised exactly. Within a class a word has its share of the class's count in all
training texts, less the share that Good and Turing give to words never seen.

Counts cover all training texts: each block asks the buckets for its words' counts, so a word that is in every text costs one
entry a block, and no vocabulary is held in one place. Words are told apart by 64-bit hashes.

Defined cases: a null or empty text is one token, the end; a null id takes part in scoring but not in training; a repeated id is a
row of its own; without training texts all counts are 0 and all outcomes alike; other columns are left out, whatever their names; an
empty table gives no rows. A document is one task's work, at some 100 bytes of memory for each of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreco.llm.blocks import NO_ID, Block, Words, bucket_bounds, bucket_count, exchange, pack_blocks, per_block, squeeze, text_bytes, tree_merge, unsqueeze
from sparkreco.llm.storage import materialize

#: Most frequent words with outcomes of their own; classes of the others; columns of the vectors.
SHORTLIST, CLASSES, DIM = 800, 64, 20
END = CLASSES  # outcomes: the classes, the end of a text, then the shortlist; one more stands before a text


def word_class(words: Words) -> np.ndarray:
    """By the last two bytes: endings tell languages and kinds of words apart."""
    if not len(words):
        return np.zeros(0, np.uint8)
    last, before = words.data[words.ends - 1].astype(np.uint32), words.data[np.maximum(words.ends - 2, words.starts)].astype(np.uint32)
    return (((last * 257 + before) * np.uint32(2654435761)) >> np.uint32(32 - 6)).astype(np.uint8)


@dataclass
class Counts:
    """Of all training tokens: their number, different ones, texts; by class count, kinds and words seen once; the shortlist."""

    tokens: int
    kinds: int
    texts: int
    by_class: np.ndarray
    short_keys: np.ndarray
    short_counts: np.ndarray
    short_class: np.ndarray


@dataclass
class Net:
    """Vectors of contexts (one more than outcomes: what stands before a text) and of outcomes, weights by distance, biases; sums of squared gradients."""

    context: np.ndarray
    target: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    sums: list[np.ndarray]

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.target, self.weights, self.bias

    def pack(self, weight: int) -> bytes:
        return struct.pack("<d", weight) + (np.concatenate([x.ravel() for x in self.parts]) * weight).tobytes()

    def unpack(self, state: bytes) -> Net:
        """A network of this one's shape from the summed states of several."""
        flat, at, out = np.frombuffer(state, np.float64), 1, []
        for x in self.parts:
            out.append((flat[at : at + x.size] / flat[0]).reshape(x.shape))
            at += x.size
        return Net(*out, self.sums)


def add_states(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(x, np.float64) for x in states], axis=0).tobytes()


@dataclass
class Model:
    counts: Counts
    prior: np.ndarray  # how often each outcome is in all training texts
    unseen: np.ndarray
    first: np.ndarray | None = None  # [context before the last, outcome], [last context, outcome], normaliser of both
    second: np.ndarray | None = None
    bias: np.ndarray | None = None
    normaliser: np.ndarray | None = None

    def use(self, net: Net) -> None:
        first, second = (net.context * net.weights[0]) @ net.target.T, (net.context * net.weights[1]) @ net.target.T
        self.first, self.second, self.bias = (x.astype(np.float32) for x in (first, second, net.bias))
        self.normaliser = normalisers(first, second, net.bias)

    def outcomes(self, keys: np.ndarray, classes: np.ndarray) -> np.ndarray:
        short = self.counts.short_keys
        if not len(short):
            return classes.astype(np.int64)
        at = np.minimum(np.searchsorted(short, keys), len(short) - 1)
        return np.where(short[at] == keys, END + 1 + at, classes)

    def log10(self, before: np.ndarray, last: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        return (self.first[before, outcome] + self.second[last, outcome] + self.bias[outcome] - self.normaliser[before, last]) / np.log(10)

    def training_tokens(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outcomes and the two before each, of the block's marked texts."""
        words = block.words(lower=True)
        marked = block.flags.astype(bool)
        sizes = np.diff(words.at)
        outcome = self.outcomes(words.hashes, word_class(words))[np.repeat(marked, sizes)]
        return contexts(outcome, np.concatenate([[0], np.cumsum(sizes[marked])]), len(self.prior))[:3]


def contexts(outcomes: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' tokens with an end each: outcomes, the two before each, and where each text's tokens start, and the end."""
    n = len(at) - 1
    begin = at + np.arange(n + 1)
    tokens = np.full(begin[-1], END, np.int64)
    tokens[np.arange(at[-1]) + np.repeat(np.arange(n), np.diff(at))] = outcomes
    last, before = np.concatenate([[start], tokens[:-1]]), np.concatenate([[start, start], tokens[:-2]])[: len(tokens)]
    last[begin[:-1]] = start
    before[begin[:-1]] = start
    second = begin[:-1][np.diff(begin) > 1] + 1
    before[second] = start
    return tokens, before, last, begin


def start_net(prior: np.ndarray, seed: int = 3) -> Net:
    rng, n = np.random.default_rng(seed), len(prior)
    parts = [rng.normal(0, 0.1, (n + 1, DIM)), rng.normal(0, 0.1, (n, DIM)), np.ones((2, DIM)), np.log(prior)]
    return Net(*parts, [np.full(x.shape, 1e-3) for x in parts])


def _scattered(n: int, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values by row, for n rows."""
    out = np.zeros((n, values.shape[1]))
    order = np.argsort(rows)
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out[rows[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def learn(net: Net, tokens: np.ndarray, before: np.ndarray, last: np.ndarray, prior: np.ndarray, rng: np.random.Generator, epochs: int = 1, noise: int = 64, batch: int = 1024, rate: float = 0.1) -> None:
    """Noise-contrastive estimation: tokens against noise drawn from prior, the same for all tokens of a batch, so that scores are matrix products."""
    n = len(prior)
    cumulative, log_noise = np.cumsum(prior), np.log(noise * prior)
    context, target, weights, bias = net.parts
    for _ in range(epochs):
        order = rng.permutation(len(tokens))
        for s in range(0, len(order), batch):
            own = order[s : s + batch]
            w, a, b = tokens[own], before[own], last[own]
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(noise) * cumulative[-1]), n - 1)
            ca, cb = context[a], context[b]
            predicted = weights[0] * ca + weights[1] * cb
            true, false = target[w], target[drawn]
            error = 1 / (1 + np.exp(-np.clip((predicted * true).sum(1) + bias[w] - log_noise[w], -30, 30))) - 1
            wrong = 1 / (1 + np.exp(-np.clip(predicted @ false.T + bias[drawn] - log_noise[drawn], -30, 30)))
            back = error[:, None] * true + wrong @ false
            grads = [
                _scattered(n + 1, np.concatenate([a, b]), np.concatenate([back * weights[0], back * weights[1]])),
                _scattered(n, np.concatenate([w, drawn]), np.concatenate([error[:, None] * predicted, wrong.T @ predicted])),
                np.stack([(back * ca).sum(0), (back * cb).sum(0)]),
                np.bincount(w, error, n) + np.bincount(drawn, wrong.sum(0), n),
            ]
            for x, g, total in zip(net.parts, grads, net.sums, strict=True):
                total += g * g
                x -= rate * g / np.sqrt(total)


def normalisers(first: np.ndarray, second: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log of the sum over all outcomes for every pair of contexts. exp(first) times exp(second + bias) is one matrix product a row of pairs."""
    top1, top2 = first.max(1, keepdims=True), (second + bias).max(1, keepdims=True)
    return (np.log(np.exp(first - top1) @ np.exp(second + bias - top2).T + 1e-300) + top1 + top2.T).astype(np.float32)


def _ask(block: Block, n: int) -> tuple[dict[int, bytes], Words, np.ndarray, np.ndarray]:
    words = block.words(lower=True)
    keys, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, block.flags[words.owner()], len(keys)).astype(np.uint32)
    classes = word_class(words)[first]
    edges = bucket_bounds(keys, n)
    out = {}
    for k in np.flatnonzero(np.diff(edges)).tolist():
        s = slice(edges[k], edges[k + 1])
        out[k] = squeeze(struct.pack("<q", edges[k + 1] - edges[k]) + keys[s].tobytes() + counts[s].tobytes() + classes[s].tobytes())
    return out, words, keys, inverse


def _read(row: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = unsqueeze(row)
    m = struct.unpack_from("<q", raw)[0]
    return np.frombuffer(raw, np.uint64, m, 8), np.frombuffer(raw, np.uint32, m, 8 + 8 * m), np.frombuffer(raw, np.uint8, m, 8 + 12 * m)


def _totals(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    parts = [_read(r) for r in rows]
    keys, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
    classes = np.concatenate([p[2] for p in parts])[first]
    return keys, total, classes, np.split(inverse, np.cumsum([len(p[0]) for p in parts])[:-1])


def _answer(rows: list[bytes]) -> list[bytes]:
    _, total, _, places = _totals(rows)
    return [squeeze(total[p].tobytes()) for p in places]


def _summary(rows: list[bytes]) -> bytes:
    keys, total, classes, _ = _totals(rows)
    seen = total > 0
    by_class = np.stack([np.bincount(classes, w, CLASSES) for w in (total, seen, total == 1)]).astype(np.int64)
    top = np.lexsort((keys, -total))[:SHORTLIST]
    return _pack_summary(by_class, keys[top], total[top], classes[top])


def _pack_summary(by_class: np.ndarray, keys: np.ndarray, total: np.ndarray, classes: np.ndarray) -> bytes:
    keep = total > 0
    return by_class.tobytes() + struct.pack("<q", int(keep.sum())) + keys[keep].tobytes() + total[keep].tobytes() + classes[keep].tobytes()


def _merge(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = 3 * CLASSES * 8
    by_class, keys, total, classes = np.zeros((3, CLASSES), np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for r in rows:
        by_class += np.frombuffer(r, np.int64, 3 * CLASSES).reshape(3, CLASSES)
        m = struct.unpack_from("<q", r, size)[0]
        keys.append(np.frombuffer(r, np.uint64, m, size + 8))
        total.append(np.frombuffer(r, np.int64, m, size + 8 + 8 * m))
        classes.append(np.frombuffer(r, np.uint8, m, size + 8 + 16 * m))
    keys, total, classes = np.concatenate(keys), np.concatenate(total), np.concatenate(classes)
    top = np.lexsort((keys, -total))[:SHORTLIST]
    return by_class, keys[top], total[top], classes[top]


def _gather(counted: DataFrame) -> Counts:
    """The buckets' summaries, merged step by step, so that the driver gets a fixed number of rows."""
    summaries = counted.filter("block = -1").select(F.col("bucket").cast("long").alias("part"), F.col("answer").alias("state"))
    by_class, keys, total, classes = _merge(tree_merge(summaries, lambda states: _pack_summary(*_merge(states))))
    order = np.argsort(keys)
    return Counts(int(by_class[0].sum()), int(by_class[1].sum()), 0, by_class, keys[order], total[order], classes[order])


def start(texts: list[str], counts: Counts) -> tuple[Model, Net]:
    """What the counts of all training texts give, and the network that the sample texts give to start from."""
    by_class = counts.by_class.astype(float).copy()
    for row, add in ((0, counts.short_counts), (1, 1), (2, counts.short_counts == 1)):
        by_class[row] -= np.bincount(counts.short_class, np.broadcast_to(add, counts.short_class.shape), CLASSES)
    seen, once = by_class[0], by_class[2]
    unseen = np.clip((once + 1) / (seen + once + 2), 1e-4, 1.0)
    prior = np.concatenate([seen + once + 1, [counts.texts + 1], counts.short_counts]).astype(float)
    model = Model(counts, prior / prior.sum(), unseen)
    net = start_net(model.prior)
    offsets, data = text_bytes(pa.array(texts, pa.string()))
    sample = Block(np.zeros(len(texts), np.int64), offsets, data, np.ones(len(texts), np.uint8))
    learn(net, *model.training_tokens(sample), model.prior, np.random.default_rng(3), epochs=3, batch=512)
    return model, net


def fit(texts: list[str], counts: Counts) -> Model:
    """A model whose network knows the sample texts alone."""
    model, net = start(texts, counts)
    model.use(net)
    return model


#: Bytes of a shard of training texts, and of what a network learns from at a time.
SHARD_BYTES, SLICE_BYTES = 8 << 20, 1 << 20


def _learned(texts: DataFrame, total: int, model: Model, net: Net) -> Net:
    """The network after the tokens of all training texts (id, text): each shard's own pass from the same start, averaged by tokens.

    Shards go by a hash of the rows, their number by the bytes of all texts, and a shard's rows are put in order: how the table is dealt to
    tasks doesn't matter.
    """
    sent = texts.sparkSession.sparkContext.broadcast((model, net))
    shards = max(1, -(-total // SHARD_BYTES))

    def run(table: pa.Table) -> pa.Table:
        m, begin = sent.value
        own = Net(*(x.copy() for x in begin.parts), [x.copy() for x in begin.sums])
        part, seen = table.column("part")[0].as_py(), 0
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        offsets, data = text_bytes(table.column("text").combine_chunks())
        rng, at = np.random.default_rng(part), 0
        while at < len(table):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            block = Block(np.zeros(upto - at, np.int64), offsets[at : upto + 1] - offsets[at], data[offsets[at] : offsets[upto]], np.ones(upto - at, np.uint8))
            tokens = m.training_tokens(block)
            learn(own, *tokens, m.prior, rng)
            seen += len(tokens[0])
            at = upto
        return pa.table({"part": pa.array([part], pa.int64()), "state": pa.array([own.pack(seen)], pa.binary())})

    dealt = texts.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    states = materialize(dealt.groupBy("part").applyInArrow(run, "part long, state binary"), "bilinear-nets")
    found = tree_merge(states, add_states)
    return net.unpack(add_states(found)) if found else net


def score_texts(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", sample_texts: int = 1500, longest: int = 100_000) -> DataFrame:
    """(id_col, trained boolean, n_tokens, n_known, train_tokens long, base_score, score double), a row for each row of df.

    training: which rows are learned from. sample_texts: about how many of them, of up to `longest` characters and chosen by a hash of the
    id, the network starts from (twice as many at most); it then learns from all training rows, and all counts come from these.
    """
    chosen = F.coalesce(training & F.col(id_col).isNotNull(), F.lit(False))
    blocks = pack_blocks(df, id_col, text_col, "bilinear-blocks", flag=chosen)
    n = bucket_count(blocks)
    counted = exchange(blocks, lambda block, _: _ask(block, n)[0], _answer, "bilinear-counts", summary=_summary)
    counts = _gather(counted)
    counts.texts = df.filter(chosen).count()
    share = max(1, min(1_000_000, round(1_000_000 * sample_texts / max(1, counts.texts))))
    rank = F.xxhash64(id_col, F.lit("bilinear"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = df.filter(chosen & (F.pmod(rank, F.lit(1_000_000)) < share) & (F.length(text) <= longest))
    picked = picked.select(F.col(id_col).alias("id"), text.alias("text")).orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(2 * sample_texts).collect()
    model, net = start([r["text"] for r in picked], counts)
    total_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    model.use(_learned(df.filter(chosen).select(F.col(id_col).cast("long").alias("id"), text.alias("text")), total_bytes, model, net))
    sent = df.sparkSession.sparkContext.broadcast(model)
    # the end is a token that each text has
    total, kinds = counts.tokens + counts.texts, counts.kinds + (counts.texts > 0)

    def score(_: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.Table]:
        m = sent.value
        asked, words, keys, inverse = _ask(block, n)
        found = [np.frombuffer(unsqueeze(got[k]), np.int64) for k in asked]
        c = np.concatenate(found)[inverse] if found else np.zeros(0, np.int64)
        classes = word_class(words)
        outcome = m.outcomes(words.hashes, classes)
        tokens, before, last, begin = contexts(outcome, words.at, len(m.bias))
        word_at = np.arange(len(words)) + words.owner()
        base = np.full(len(tokens), np.log10((counts.texts + 0.5) / (total + 0.5 * (kinds + 1))))
        base[word_at] = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        log = m.log10(before, last, tokens).astype(float)
        inner = np.flatnonzero(outcome < END)
        in_class = np.maximum(_class_counts(counts)[outcome[inner]], 1)
        log[word_at[inner]] += np.log10(np.where(c[inner] > 0, (1 - m.unseen[outcome[inner]]) * np.maximum(c[inner], 1) / in_class, m.unseen[outcome[inner]]))
        known = np.full(len(tokens), counts.texts > 0)
        known[word_at] = c > 0
        text = np.repeat(np.arange(len(block)), np.diff(begin))
        yield pa.table(
            {
                id_col: pa.array(block.ids, pa.int64(), mask=block.ids == NO_ID), "trained": pa.array(block.flags.astype(bool)), "n_tokens": pa.array(np.diff(begin), pa.int64()),
                "n_known": pa.array(np.bincount(text, known, len(block)).astype(np.int64)), "train_tokens": pa.array(np.full(len(block), total), pa.int64()),
                "base_score": pa.array(np.bincount(text, base, len(block))), "score": pa.array(np.bincount(text, log, len(block))),
            }
        )

    return per_block(blocks, counted, score, f"`{id_col}` long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _class_counts(counts: Counts) -> np.ndarray:
    return counts.by_class[0] - np.bincount(counts.short_class, counts.short_counts, CLASSES)
