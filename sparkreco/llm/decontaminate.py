"""Benchmark decontamination: passages of training documents as BM25 queries against an inverted index of test items.

Words are runs of letters, digits and bytes beyond ASCII, in lower case. Every document is read whole, as passages that suit an item's own
length: their half is the least power of two that is a quarter more than its words, and each starts halfway into the one before, so
that the item lies within one passage. Items of one such half make an index of their own, so what is found of an item doesn't depend
on the lengths of others. A passage's score for
an item is the sum of the BM25 weights of the item's terms that it has, divided by the item's sum over all of its terms: from 0 to 1. All
items of `retrieve` or more are retrieved: first the block-max bounds, the sums over a passage's terms of each term's
largest weight in a block of items, leave out blocks that can't reach the threshold; in the blocks that are left, WAND moves along the
posting lists to each item whose terms' largest weights can. A retrieved item counts as leaked if enough of the word
trigrams of its first half (the question) and of its second half (the answer) stand in the passage; a half of fewer words is compared
whole, and so is an item of fewer than 5 words: its word sequence must stand in the passage.

The index is broadcast; the items are read in shards of at most SHARD_ITEMS, so its size is bounded, and a larger benchmark takes more
passes. Posting lists and block bounds are sparse: an item takes some 30 bytes a term, a shard of 50-word items some 12 MB. The number of items, their average length and the terms' document frequencies are those of all items, counted once.

Defined cases: null or empty texts match nothing; items without words are not searched for; a null item id is carried along; repeated
items match each by itself; documents of any id and length are rows of their own; without items nothing is leaked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreco.llm import hashing
from sparkreco.llm.blocks import text_bytes
from sparkreco.llm.hashing import span_hashes
from sparkreco.llm.samples import unused
from sparkreco.llm.toxicity import _WORD, slices

SHARD_ITEMS, BLOCK_ITEMS, HALVED_WORDS, K1, B = 8192, 4, 5, 1.2, 0.75
#: Block bounds of passages' terms that are summed up at once, and the sums that they go to.
BOUNDS, SUMS = 1 << 20, 1 << 20
LEAKS = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts in lower case, of whatever script."""
    return text_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def term_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lowered texts, and where each text's words start, and the end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    is_word = np.zeros(len(data) + 2, bool)
    is_word[1:-1] = _WORD[data]
    starts, ends = np.flatnonzero(is_word[1:] & ~is_word[:-1]), np.flatnonzero(~is_word[1:] & is_word[:-1])
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = inner[is_word[inner] & is_word[inner + 1]]
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets, side="left")


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row."""
    return np.unique(hashing.grams(words, n))


def halves(words: np.ndarray) -> tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]:
    """What is compared of question and answer: the number of words in a row, and their hashes."""
    h = len(words) // 2
    if len(words) < HALVED_WORDS:
        return ((len(words), grams(words, len(words))),) * 2
    return tuple((min(3, len(w)), grams(w, min(3, len(w)))) for w in (words[:h], words[h:]))


@dataclass
class Index:
    ids: list
    terms: np.ndarray  # sorted hashes
    items: list[np.ndarray]  # posting lists: item numbers in order, and weights
    weights: list[np.ndarray]
    most: np.ndarray  # each term's largest weight
    blocks: int
    block_at: np.ndarray  # where each term's blocks start, and the end
    block_no: np.ndarray  # the blocks that have the term
    block_most: np.ndarray  # the term's largest weight in each of them
    halves: list[tuple]  # of each item, as halves() gives them
    half: int  # words of half a passage


@dataclass
class Stats:
    """Of all items that have words: their number, average number of words, and how many of them have each term."""

    items: int
    mean: float
    having: dict[int, int]  # by the term's hash as a signed number


def half_passage(n_words: int) -> int:
    """Words of half a passage for an item: a power of two, a quarter more than the item's at least."""
    return 1 << (-(-5 * n_words // 4) - 1).bit_length()


def build_indexes(ids: list, texts: list[str | None], stats: Stats | None = None) -> list[Index]:
    """An index for each half of passages that the items have. stats: of all items, if these are a shard of them."""
    hashes, at = term_hashes(*lowered(pa.array(texts, pa.string())))
    words = [hashes[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
    if stats is None:
        kinds, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, words)]), return_counts=True)
        used = [len(w) for w in words if len(w)]
        stats = Stats(len(used), float(np.mean(used)) if used else 0.0, dict(zip(kinds.view(np.int64).tolist(), counts.tolist(), strict=True)))
    own: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w):
            own.setdefault(half_passage(len(w)), []).append(i)
    return [_index([ids[i] for i in use], [words[i] for i in use], half, stats) for half, use in sorted(own.items())]


def _index(use: list, words: list[np.ndarray], half: int, stats: Stats) -> Index:
    sizes = np.array([len(w) for w in words], float)
    terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    found = [[] for _ in terms]
    for i, w in enumerate(words):
        kinds, counts = np.unique(w, return_counts=True)
        for t, c in zip(np.searchsorted(terms, kinds).tolist(), counts.tolist(), strict=True):
            found[t].append((i, c))
    having = [stats.having[t] for t in terms.view(np.int64).tolist()]
    n, mean = stats.items, stats.mean
    idf = np.array([np.log(1 + (n - df + 0.5) / (df + 0.5)) for df in having])
    items = [np.array([i for i, _ in f]) for f in found]
    weights = []
    total = np.zeros(len(use))
    for t, f in enumerate(found):
        tf = np.array([c for _, c in f], float)
        w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[items[t]] / mean))
        total[items[t]] += w
        weights.append(w)
    weights = [w / total[i] for w, i in zip(weights, items, strict=True)]
    starts = [np.flatnonzero(np.diff(i // BLOCK_ITEMS, prepend=-1)) for i in items]
    block_at = np.concatenate([[0], np.cumsum([len(x) for x in starts])]).astype(np.int64)
    block_no = np.concatenate([np.zeros(0, np.int32), *[(i[x] // BLOCK_ITEMS).astype(np.int32) for i, x in zip(items, starts, strict=True)]])
    block_most = np.concatenate([np.zeros(0, np.float32), *[(np.maximum.reduceat(w, x) * (1 + 1e-6)).astype(np.float32) for w, x in zip(weights, starts, strict=True)]])
    most = np.array([w.max() for w in weights])
    return Index(use, terms, items, weights, most, -(-len(use) // BLOCK_ITEMS), block_at, block_no, block_most, [halves(w) for w in words], half)


def wand(index: Index, terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items in the blocks whose terms among `terms` weigh threshold or more."""
    out = []
    lists = [(index.items[t], index.weights[t], float(index.most[t])) for t in terms]
    at = [0] * len(lists)
    allowed = np.zeros(index.blocks + 1, bool)
    allowed[blocks] = True
    while True:
        live = sorted((int(lists[k][0][at[k]]), k) for k in range(len(lists)) if at[k] < len(lists[k][0]))
        bound, pivot = 0.0, None
        for item, k in live:
            bound += lists[k][2]
            if bound >= threshold:
                pivot = item
                break
        if pivot is None:
            return out
        block = pivot // BLOCK_ITEMS
        if not allowed[block]:  # the block's own bounds rule it out: on to the next block that they don't
            later = np.searchsorted(blocks, block)
            if later == len(blocks):
                return out
            target = int(blocks[later]) * BLOCK_ITEMS
            for item, k in live:
                if item < target:
                    at[k] += int(np.searchsorted(lists[k][0][at[k] :], target))
        elif live[0][0] == pivot:
            score = sum(float(lists[k][1][at[k]]) for item, k in live if item == pivot)
            if score >= threshold:
                out.append((pivot, score))
            for item, k in live:
                if item == pivot:
                    at[k] += 1
        else:
            for item, k in live:
                if item < pivot:
                    at[k] += int(np.searchsorted(lists[k][0][at[k] :], pivot))


def _reached(index: Index, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, retrieve: float) -> Iterator[tuple[int, np.ndarray]]:
    """The passages, and of each the blocks, whose bounds reach the threshold."""
    first, n = index.block_at[kind], np.diff(index.block_at)[kind]
    before = np.concatenate([[0], np.cumsum(n)])
    k = 0
    while k < len(starts):
        upto = int(np.searchsorted(before[ends], before[starts[k]] + BOUNDS, side="right"))
        upto = max(k + 1, min(upto, k + SUMS // index.blocks))
        s, e = starts[k], ends[upto - 1]
        at = np.repeat(first[s:e] - before[s:e], n[s:e]) + np.arange(before[s], before[e])
        row = np.repeat(np.repeat(np.arange(upto - k), ends[k:upto] - starts[k:upto]), n[s:e])
        sums = np.bincount(row * index.blocks + index.block_no[at], weights=index.block_most[at], minlength=(upto - k) * index.blocks)
        reached = np.flatnonzero(sums >= retrieve)
        rows, of_row = np.unique(reached // index.blocks, return_index=True)
        for r, i, j in zip(rows.tolist(), of_row, [*of_row[1:], len(reached)], strict=False):
            yield k + r, reached[i:j] % index.blocks
        k = upto


def leaks_of(indexes: list[Index], offsets: np.ndarray, data: np.ndarray, retrieve: float, overlap: float) -> list[list[dict]]:
    """For each text the leaked items, with the best passage's score and overlaps."""
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    hashes, at = term_hashes(offsets, data)
    for index in indexes:
        for own, found in zip(out, _leaks_of(index, hashes, at, retrieve, overlap), strict=True):
            own += [{"item_id": index.ids[i], "score": s, "question": q, "answer": a} for i, (s, q, a) in sorted(found.items())]
    return [sorted(x, key=lambda y: (y["item_id"] is None, y["item_id"] or 0)) for x in out]


def _leaks_of(index: Index, hashes: np.ndarray, at: np.ndarray, retrieve: float, overlap: float) -> list[dict]:
    out: list[dict] = [{} for _ in range(len(at) - 1)]
    term = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    place = np.flatnonzero(index.terms[term] == hashes)
    term = term[place]
    doc = np.searchsorted(at, place, side="right") - 1
    step = index.half
    half = (place - at[doc]) // step  # a passage is two halves
    base = np.concatenate([[0], np.cumsum(np.maximum(-(-np.diff(at) // step), 1))])
    n_terms = len(index.terms)
    one = base[doc] + half
    both = np.unique(np.concatenate([one * n_terms + term, (one - 1)[half > 0] * n_terms + term[half > 0]]))
    passage, kind = both // n_terms, both % n_terms
    if not len(passage):
        return out
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    ends = np.concatenate([starts[1:], [len(passage)]])
    for k, blocks in _reached(index, kind, starts, ends, retrieve):
        own = kind[starts[k] : ends[k]]
        number = int(passage[starts[k]])
        d = int(np.searchsorted(base, number, side="right")) - 1
        s = int(at[d] + (number - base[d]) * step)
        words: dict[int, np.ndarray] = {}
        for item, score in wand(index, own, blocks, retrieve):
            for n, _ in index.halves[item]:
                if n not in words:
                    words[n] = grams(hashes[s : min(s + 2 * step, at[d + 1])], n)
            q, a = (float(np.isin(g, words[n], assume_unique=True).mean()) for n, g in index.halves[item])
            if q >= overlap and a >= overlap and score > out[d].get(item, (0.0,))[0]:
                out[d][item] = (score, q, a)
    return out


def _counted(items: DataFrame) -> DataFrame:
    """(id, text) with the number of words and the different terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = term_hashes(*lowered(b.column(1)))
            terms = [np.unique(hashes[s:e]).view(np.int64) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(at), pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["id", "text", "words", "terms"])

    return items.mapInArrow(run, "id long, text string, words long, terms array<long>")


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", retrieve: float = 0.5, overlap: float = 0.5, name: str = "leaks") -> DataFrame:
    """docs with a column `name`, in the place of one of that name: the items that a row's text holds, one struct each."""
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    counted = _counted(rows).persist()
    n_items, n_used, mean = counted.agg(F.count("*"), F.count_if(F.col("words") > 0), F.avg(F.when(F.col("words") > 0, F.col("words")))).first()
    having = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).persist()
    shards = max(1, -(-n_items // (SHARD_ITEMS // 2)))  # by hash: half full on average, so that none is over
    names = [c for c in docs.columns if c != name]
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.expr(f"CAST(array() AS {LEAKS})").alias(name))
    schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes[:-1]) + f", `{name}` {LEAKS}"
    text_at = names.index(text_col)
    for shard in range(shards):
        part = counted.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard)
        own = part.select("id", "text").orderBy("id", "text").collect()
        terms = having.join(part.select(F.explode("terms").alias("term")), "term", "left_semi").collect()
        stats = Stats(n_used, mean or 0.0, {r["term"]: r["n"] for r in terms})
        index = spark.sparkContext.broadcast(build_indexes([r["id"] for r in own], [r["text"] for r in own], stats))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offsets, data = lowered(b.column(text_at))
                found: list[list] = []
                for s, e in slices(offsets):
                    found += leaks_of(index.value, offsets[s : e + 1] - offsets[s], data[offsets[s] : offsets[e]], retrieve, overlap)
                found = [x + y for x, y in zip(b.column(len(names)).to_pylist(), found, strict=True)] if shards > 1 else found
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, b.schema.field(name).type)], b.schema.names)

        out = out.mapInArrow(run, schema)
    counted.unpersist()
    having.unpersist()
    return out


def drop_leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without leaked items; columns as in docs."""
    name = unused("__leaks", docs.columns)
    return find_leaks(docs, items, name=name).filter(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
