"""Alignment of two tokenizers' tokens: a byte-level vocabulary (A) and a vocabulary of marked pieces (B).

The tokens of a text and their overlaps are a bipartite graph; its connected components, found by union-find, are exactly the groups
between neighbouring places where tokens of both ends meet. The members of a component are linked, each A token with each B token,
and id pairs are counted over all documents.

Both tokenizers end a token where a run of blanks begins behind other than white space. Documents are packed into blocks, and a
block aligns each of its different words once: what holds for a text is the sum over its words. Pairs that documents of a
block hold go to the bucket of their A id with the number of these documents; a bucket adds up what all blocks sent,
finds each A id's highest count and answers. A pair that all documents hold is one entry a block.

Defined cases: a text that is null, empty, or not the bytes of its tokens (a marker in it) has no tokens, zeros and no groups; a null
or repeated id is carried along, each row counts as a document; an empty table gives no rows; columns beside the two named
ones don't matter, whatever they are called. A text without blanks is one word, in one task; large groups are counted by their
different ids, whose number of pairs the vocabularies bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreco.llm.blocks import NO_ID, Block, bucket_count, exchange, pack_blocks, per_block, squeeze, unsqueeze
from sparkreco.llm.bpe import codec
from sparkreco.llm.hashing import mix
from sparkreco.llm.pieces import check_model, pieces
from sparkreco.llm.words import MARK, gathered, numbered_words, plain_words, sums

#: Bytes of text for which there is a bucket of pairs.
BUCKET_BYTES = 8 << 20
#: Links of a group beyond which they are made from its different ids.
LARGE_GROUP = 1 << 12
#: Characters of words that are encoded as one text, and bytes of a block.
STRETCH, BLOCK_BYTES = 1 << 9, 6 << 20
B_BITS = 32


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find: the least node that each of n nodes is connected with by the edges (a, b)."""
    parent = np.arange(n)
    while True:
        a, b = parent[a], parent[b]
        live = a != b
        if not live.any():
            return parent
        a, b = a[live], b[live]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:  # every node to its root
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def group_tokens(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, from 0 on in their order; sizes are those of the tokens in bytes, equal in sum."""
    n = len(a_sizes)
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    first = np.searchsorted(b_ends, a_ends - a_sizes, side="right")
    last = np.searchsorted(b_ends, a_ends, side="left")
    met = last - first + 1
    root = components(n + len(b_sizes), np.repeat(np.arange(n), met), n + gathered(first, met, np.arange(n)))
    # every component has an A token, and the least node is its first one
    number = np.cumsum(root[:n] == np.arange(n)) - 1
    return number[root[:n]], number[root[n:]]


class Tokens:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, ranks: bytes, pattern: str, model: bytes):
        self.a, self.b = codec(ranks, pattern), pieces(model)
        m = self.b.model
        self.a_bytes = self.a.bytes_of
        self.b_bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # an id with what follows it in the text of the groups: another one of its side, or the other side
        self.a_text, self.b_text = [f"{i}{s}" for s in ",|" for i in range(len(self.a_bytes))], [f"{i}{s}" for s in ",;" for i in range(len(self.b_bytes))]

    def _flat(self, words: list[str], texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """The ids of the words, whose concatenation the texts are, and their number in each word; None if tokens aren't the words' bytes."""
        out = []
        own = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        for coded, size, parts in (([self.a.encode(x) for x in texts], self.a_size, self.a_bytes), (self.b.encode(texts), self.b_size, self.b_bytes)):
            ids = np.fromiter(chain.from_iterable(coded), np.int64, sum(map(len, coded)))
            upto = np.cumsum(size[ids])
            last = np.searchsorted(upto, ends)
            if len(own) and (not len(ids) or int(last[-1]) >= len(ids) or (upto[last] != ends).any()):
                return None
            # A's tokens are the text's bytes whatever the text is
            if parts is self.b_bytes and b"".join(map(parts.__getitem__, ids.tolist())) != b"".join(own):
                return None
            out.append((ids, np.diff(last, prepend=-1)))
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which words are the bytes of their tokens, and for A and B the ids of these words and their numbers."""
        whole = np.ones(len(words), bool)
        # words that no white space ends are encoded together: tokens end between them
        closed = np.array([not w[-1].isspace() for w in words], bool)
        order = np.concatenate([np.flatnonzero(closed), np.flatnonzero(whole & ~closed)])
        own, n = [words[i] for i in order.tolist()], int(closed.sum())
        stretch = np.cumsum(np.fromiter(map(len, own[:n]), np.int64, n)) // STRETCH
        cuts = [*np.flatnonzero(np.diff(stretch, prepend=-1)).tolist(), n]
        found = self._flat(own, ["".join(own[x:y]) for x, y in zip(cuts, cuts[1:])] + own[n:])  # noqa: B905
        if found is None:
            each = [self._flat([w], [w]) for w in own]
            whole[order[[x is None for x in each]]] = False
            order = order[[x is not None for x in each]]
            each = [x for x in each if x is not None]
            found = [tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*(y[side] for y in each), strict=True)) if each else (np.zeros(0, np.int64),) * 2 for side in (0, 1)]
        out = []
        for ids, counts in found:
            starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            starts[order], sizes[order] = np.cumsum(counts) - counts, counts
            out.append((ids[gathered(starts, sizes, np.arange(len(words)))], sizes))
        return whole, out


@lru_cache(1)
def tokens(ranks: bytes, pattern: str, model: bytes) -> Tokens:
    return Tokens(ranks, pattern, model)


@dataclass
class Words:
    """What holds for each different word of a block. pair_at: where its different id pairs start in pairs (A id, B id in one number) and times."""

    whole: np.ndarray
    counts: dict[str, np.ndarray]
    pair_at: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    texts: list[str]


def align_words(t: Tokens, words: list[str], with_texts: bool) -> Words:
    whole, ((a, n_a), (b, n_b)) = t.encode(words)
    ga, gb = group_tokens(t.a_size[a], t.b_size[b])
    n = int(ga[-1]) + 1 if len(ga) else 0
    p, q = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    a_at, b_at = np.cumsum(p) - p, np.cumsum(q) - q
    owner = np.repeat(np.arange(len(words)), n_a)[a_at] if n else np.zeros(0, np.int64)
    counts = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(owner, minlength=len(words)), "n_links": np.bincount(owner, p * q, len(words)).astype(np.int64)}

    # links of small groups one by one, of large ones by their different ids
    small = p * q <= LARGE_GROUP
    mine = np.flatnonzero(small[ga])
    links = [(np.repeat(owner[ga[mine]], q[ga[mine]]), np.repeat(a[mine], q[ga[mine]]) << B_BITS | b[gathered(b_at, q, ga[mine])], None)]
    for g in np.flatnonzero(~small).tolist():
        (x, nx), (y, ny) = np.unique(a[a_at[g] : a_at[g] + p[g]], return_counts=True), np.unique(b[b_at[g] : b_at[g] + q[g]], return_counts=True)
        links.append((np.full(len(x) * len(y), owner[g]), (x[:, None] << B_BITS | y).ravel(), (nx[:, None] * ny).ravel()))
    who, pair, times = (np.concatenate(x) for x in zip(*((w, k, np.ones(len(k), np.int64) if m is None else m) for w, k, m in links), strict=True))
    order = np.lexsort((pair, who))
    who, pair, times = who[order], pair[order], times[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    pair_at = np.searchsorted(who[first], np.arange(len(words) + 1))

    words_of = Words(whole, counts, pair_at, pair[first], np.add.reduceat(times, first) if len(first) else times, [])
    if not with_texts:
        return words_of
    # the text of a word's groups: its tokens in the order of the groups, A before B
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[a_at + p - 1], b_last[b_at + q - 1] = True, True
    said = np.empty(len(a) + len(b), object)
    said[np.arange(len(a)) + b_at[ga]] = np.array(list(map(t.a_text.__getitem__, (a + len(t.a_bytes) * a_last).tolist())), object)
    said[np.arange(len(b)) + (a_at + p)[gb]] = np.array(list(map(t.b_text.__getitem__, (b + len(t.b_bytes) * b_last).tolist())), object)
    said, ends = said.tolist(), np.cumsum(n_a + n_b).tolist()
    return replace(words_of, texts=["".join(said[x:y])[:-1] for x, y in zip([0, *ends], ends)])  # noqa: B905


@dataclass
class Aligned:
    """A block: the word of each occurrence, where each document's start, which documents have tokens, and the words."""

    codes: np.ndarray
    at: np.ndarray
    whole: np.ndarray
    words: Words


def align_block(t: Tokens, block: Block, with_texts: bool = False) -> Aligned:
    # a text with a marker isn't the bytes of its tokens
    different, codes, at = numbered_words(block, lambda text: [] if MARK in text else plain_words(text))
    words = align_words(t, different, with_texts)
    whole = (sums(~words.whole[codes], at) == 0) & (np.diff(at) > 0)
    return Aligned(codes, at, whole, words)


def document_counts(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a block's documents, and how many documents hold each."""
    pairs, own = np.unique(x.words.pairs, return_inverse=True)
    if not len(pairs):
        return pairs, np.zeros(0, np.int64)
    n = len(x.words.whole)
    doc = np.repeat(np.arange(len(x.whole)), np.diff(x.at))
    met = np.unique((doc * n + x.codes)[x.whole[doc]])  # words of documents
    size = np.diff(x.words.pair_at)
    held = np.repeat(met // n, size[met % n]) * len(pairs) + own[gathered(x.words.pair_at[:-1], size, met % n)]
    return pairs, np.bincount(np.unique(held) % len(pairs), minlength=len(pairs))


def _buckets(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs by the bucket of their A id, and where the buckets start."""
    bucket = (mix((pairs >> B_BITS).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _count(rows: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What each request asks for; all pairs of the requests with their summed counts, and whether these are their A ids' highest."""
    raw = [np.frombuffer(unsqueeze(r), np.int64).reshape(2, -1) for r in rows]
    pairs, own = np.unique(np.concatenate([x[0] for x in raw]), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, own, np.concatenate([x[1] for x in raw]))
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] >> B_BITS != pairs[:-1] >> B_BITS]))
    highest = np.repeat(np.maximum.reduceat(counts, first), np.diff([*first, len(pairs)]))
    return [x[0] for x in raw], pairs, counts, counts == highest


@dataclass(frozen=True)
class Alignment:
    """documents: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups string), a row for each row. pairs: (a_id, b_id, n_docs, best)."""

    documents: DataFrame
    pairs: DataFrame


def align(df: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> Alignment:
    with open(ranks_path, "rb") as f, open(model_path, "rb") as g:
        ranks, model = f.read(), g.read()
    check_model(model)
    files = df.sparkSession.sparkContext.broadcast((ranks, model))  # their size doesn't depend on the data
    blocks = pack_blocks(df, id_col, text_col, name="align-blocks", block_bytes=BLOCK_BYTES)
    n = bucket_count(blocks, blocks.agg(F.sum("n_bytes")).first()[0] or 0, BUCKET_BYTES)

    def aligned(block: Block, with_texts: bool = False) -> Aligned:
        return align_block(tokens(files.value[0], pattern, files.value[1]), block, with_texts)

    def ask(block: Block, _: dict[int, bytes]) -> dict[int, bytes]:
        pairs, docs = document_counts(aligned(block))
        order, edges = _buckets(pairs, n)
        return {k: squeeze(np.stack([pairs[own], docs[own]]).tobytes()) for k in np.flatnonzero(np.diff(edges)).tolist() for own in [order[edges[k] : edges[k + 1]]]}

    def answer(rows: list[bytes]) -> list[bytes]:
        asked, pairs, counts, best = _count(rows)
        return [squeeze(counts[own].tobytes() + best[own].tobytes()) for x in asked for own in [np.searchsorted(pairs, x)]]

    def whole_bucket(rows: list[bytes]) -> bytes:
        _, pairs, counts, best = _count(rows)
        return squeeze(np.stack([pairs, counts, best]).tobytes())

    answers = exchange(blocks, ask, answer, "align-pairs", summary=whole_bucket)

    def counted(_: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        x = aligned(block, with_texts=True)
        pairs, own = np.unique(x.words.pairs, return_inverse=True)
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        order, edges = _buckets(pairs, n)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            mine, raw = order[edges[k] : edges[k + 1]], unsqueeze(got[k])
            counts[mine] = np.frombuffer(raw, np.int64, len(mine))
            best[mine] = np.frombuffer(raw, bool, offset=8 * len(mine))
        per_word = x.words.counts | {"n_best": sums(x.words.times * best[own], x.words.pair_at), "count_sum": sums(x.words.times * counts[own], x.words.pair_at)}
        texts = [";".join(map(x.words.texts.__getitem__, x.codes[a:b].tolist())) if ok else "" for a, b, ok in zip(x.at, x.at[1:], x.whole)]  # noqa: B905
        columns = [pa.array(np.where(x.whole, sums(v[x.codes], x.at), 0)) for v in per_word.values()]
        yield pa.RecordBatch.from_arrays([pa.array(block.ids, mask=block.ids == NO_ID), *columns, pa.array(texts, pa.string())], ["id", *per_word, "groups"])

    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    documents = per_block(blocks, answers, counted, f"id long, {', '.join(f'{c} long' for c in numbers)}, groups string")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                pairs, counts, best = np.frombuffer(unsqueeze(packed.as_py()), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs >> B_BITS), pa.array(pairs & ((1 << B_BITS) - 1)), pa.array(counts), pa.array(best.astype(bool))], ["a_id", "b_id", "n_docs", "best"])

    pairs = answers.filter("block < 0").select("answer").mapInArrow(unpacked, "a_id long, b_id long, n_docs long, best boolean")
    return Alignment(documents.withColumnRenamed("id", id_col), pairs)
