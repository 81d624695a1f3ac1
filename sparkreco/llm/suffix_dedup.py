"""Suffix-array dedup: removes text that also stands in a document with a smaller id.

Every stretch of `length` bytes holds an anchor, the string of a third of its length with the least hash, and equal stretches hold it
at the same place; so all suffixes that could agree on `length` bytes fall into one bucket by their anchor. Blocks first learn which of
their anchors occur in more than one document. For these they send the text around each anchor, once a block, with the least document
id. A bucket is one task's work: it sorts the suffixes one range of first bytes at a time with difference-cover ranks (see
suffix.py), and in each run of suffixes that agree on `length` bytes finds the least document id. Texts are laid out so that anchors fall on
multiples of the cover's period: suffixes that agree then compare by one cover rank each.

Anchors and the dedup of equal texts within a block or bucket use 64-bit hashes; which stretches of different texts are equal is
decided on the bytes themselves.

Defined cases: a null or empty text has no bytes and stays empty; a null id counts as larger than all others; rows with the same
id never remove each other's text; texts shorter than length stay whole; an empty table gives no rows. Other columns are left out by
remove_repeated_bytes and come back as they were from cut_repeats, whatever their names (n_chars is counted anew). A document is one
task's work, at some 100 bytes of memory for each of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreco.llm.blocks import NO_ID, Block, answer_shared, bucket_bounds, bucket_count, exchange, key_bytes, pack_blocks, per_block, read_bits, send_by_bucket, squeeze, unsqueeze
from sparkreco.llm.hashing import BYTE_M, PAIR_M, eights, mix, span_hashes
from sparkreco.llm.suffix import SuffixSorter

BUCKET_SUFFIXES = 1 << 19
#: Places whose anchors are looked for at once.
SLICE = 1 << 15


def _gram(load: Callable[[int], np.ndarray], size: int) -> np.ndarray:
    """A hash of size bytes; load(d) gives the eight bytes d places on. High bits count most."""
    if size < 8:
        out = (load(0) & np.uint64((1 << 8 * size) - 1)) * np.uint64(PAIR_M)
    else:
        out = load(0) * np.uint64(PAIR_M)
        for d in [*range(8, size - 8, 8), *[size - 8] * (size > 8)]:
            out ^= out >> np.uint64(29)
            out += load(d)
            out *= np.uint64(PAIR_M)
    out ^= out >> np.uint64(32)
    out *= np.uint64(BYTE_M)
    return out


def _anchor_places(view: np.ndarray, n: int, length: int, size: int) -> np.ndarray:
    """For each of n places the place of the anchor of the stretch from there on; some places at a time, which stay in the cache."""
    w = length - size + 1
    bits = np.uint64((SLICE + w).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    down = low - np.arange(SLICE + w, dtype=np.uint64)
    out = np.empty(n, np.int64)
    for s in range(0, n, SLICE):
        e = min(n, s + SLICE)
        m = e - s + w - 1
        # the low bits give way to the place, so that a running minimum carries it; places count downwards
        least = _gram(lambda d, s=s, m=m: view[s + d : s + d + m], size) & ~low | down[:m]
        span = 1
        while span * 2 <= w:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: e - s], least[w - span : w - span + e - s])
        out[s:e] = s + (low - (least & low)).astype(np.int64)
    return out


class _Anchors:
    """The runs of stretches of length bytes that have the same anchor: their starts, and the anchor's place and key."""

    def __init__(self, block: Block, length: int):
        size = length // 3 + 1
        n = max(0, len(block.data) - length + 1)
        view = eights(block.data)
        place = _anchor_places(view, n, length, size)
        # no stretch starts within the last length - 1 bytes of a text
        ends = block.offsets[1:]
        short = np.minimum(np.diff(block.offsets), length - 1)
        over = np.repeat(ends - short, short) + np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
        place[over[over < n]] = -1
        edges = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)
        own = place[edges[:-1]]
        self.starts, self.ends, self.place = edges[:-1][own >= 0], edges[1:][own >= 0], own[own >= 0]
        # least hashes are small numbers: mixed anew, they spread over the buckets
        self.keys = mix(_gram(lambda d: view[self.place + d], size))


class _Stretches:
    """The runs of stretches around recurring anchors, as texts: each different text once, in the order of buckets and hashes."""

    def __init__(self, block: Block, got: dict[int, bytes], n: int, length: int):
        a = _Anchors(block, length)
        keys, inverse = np.unique(a.keys, return_inverse=True)
        # in two documents of this block, or in another block
        owner = block.owner(a.starts)
        least, most = np.full(len(keys), len(block)), np.full(len(keys), -1)
        np.minimum.at(least, inverse, owner)
        np.maximum.at(most, inverse, owner)
        hit = (read_bits(got, keys, n) | (least < most))[inverse]
        self.starts, self.ends = a.starts[hit], a.ends[hit]  # stretches start at starts to ends - 1
        self.ids = block.ids[owner[hit]]
        self.anchor = a.place[hit] - self.starts
        texts = span_hashes(block.data, self.starts, self.ends + length - 1)
        key = a.keys[hit]
        order = np.lexsort((self.ids, texts, key))
        new = np.ones(len(order), bool)
        new[1:] = texts[order][1:] != texts[order][:-1]
        #: Which text each run has; of each text the run with the least id, and its bucket bounds.
        self.text_of = np.empty(len(order), np.int64)
        self.text_of[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.edges = bucket_bounds(key[self.first], n)


def _ask_texts(block: Block, got: dict[int, bytes], n: int, length: int) -> dict[int, bytes]:
    s = _Stretches(block, got, n, length)
    out = {}
    for k in np.flatnonzero(np.diff(s.edges)).tolist():
        own = s.first[s.edges[k] : s.edges[k + 1]]
        sizes = s.ends[own] - s.starts[own] + length - 1
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        text = block.data[np.repeat(s.starts[own] - offsets[:-1], sizes) + np.arange(offsets[-1])]
        out[k] = squeeze(struct.pack("<q", len(own)) + s.ids[own].tobytes() + sizes.astype(np.int64).tobytes() + s.anchor[own].astype(np.int64).tobytes() + text.tobytes())
    return out


def _answer_texts(rows: list[bytes], length: int) -> list[bytes]:
    """For each request a bit for each stretch of its texts, one text after the other: whether a smaller id has it."""
    ids, sizes, anchors, texts, counts = [], [], [], [], []
    for r in rows:
        raw = unsqueeze(r)
        m = struct.unpack_from("<q", raw)[0]
        ids.append(np.frombuffer(raw, np.int64, m, 8))
        sizes.append(np.frombuffer(raw, np.int64, m, 8 + 8 * m))
        anchors.append(np.frombuffer(raw, np.int64, m, 8 + 16 * m))
        texts.append(np.frombuffer(raw, np.uint8, offset=8 + 24 * m))
        counts.append(m)
    ids, sizes, anchors, data = (np.concatenate(x) for x in (ids, sizes, anchors, texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    hashes = span_hashes(data, offsets[:-1], offsets[1:])
    order = np.lexsort((ids, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    text_of = np.empty(len(order), np.int64)
    text_of[order] = np.cumsum(new) - 1
    first = order[new]
    # each different text once, its anchor at a multiple of the period
    period = min(32, 1 << length.bit_length() - 1)
    own, lead = sizes[first], (-anchors[first]) % period
    room = -(-(lead + own) // period) * period
    at = np.concatenate([[0], np.cumsum(room)])[:-1] + lead
    laid, used = np.zeros(int(room.sum()), np.uint8), np.zeros(int(room.sum()), bool)
    before = np.concatenate([[0], np.cumsum(own)])
    inner = np.arange(before[-1]) + np.repeat(at - before[:-1], own)
    laid[inner] = data[np.arange(before[-1]) + np.repeat(offsets[first] - before[:-1], own)]
    used[inner] = True
    stretches = own - length + 1
    base = np.concatenate([[0], np.cumsum(stretches)])
    inner = np.arange(base[-1]) - np.repeat(base[:-1], stretches)
    places = np.repeat(at, stretches) + inner
    number = np.full(len(laid), -1, np.int32)
    number[places] = np.arange(len(places), dtype=np.int32)
    holder = np.repeat(ids[first], stretches)
    least = np.empty(len(places), np.int64)
    sorter = SuffixSorter(laid, period, length, used)
    for bucket in sorter.buckets(places, BUCKET_SUFFIXES):
        sa, new = sorter.sort(bucket)
        w, starts = number[sa], sorter.runs(sa, new)
        least[w] = np.repeat(np.minimum.reduceat(holder[w], starts), np.diff(np.concatenate([starts, [len(w)]])))
    out, at = [], 0
    for m in counts:
        t = text_of[at : at + m]
        size = stretches[t]
        inner = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)])[:-1], size)
        out.append(np.packbits(least[np.repeat(base[t], size) + inner] < np.repeat(ids[at : at + m], size)).tobytes())
        at += m
    return out


def _removed(block: Block, got_anchors: dict[int, bytes], got: dict[int, bytes], n: int, length: int) -> np.ndarray:
    """Which bytes of the block go."""
    s = _Stretches(block, got_anchors, n, length)
    size = s.ends[s.first] - s.starts[s.first]
    base = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(base[-1], bool)
    for k in np.flatnonzero(np.diff(s.edges)).tolist():
        a, b = base[s.edges[k]], base[s.edges[k + 1]]
        bits[a:b] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=int(b - a)).astype(bool)
    runs = s.ends - s.starts
    inner = np.arange(runs.sum()) - np.repeat(np.concatenate([[0], np.cumsum(runs)])[:-1], runs)
    # the run with the least id has the answer; the same text under a larger id is a repeat altogether
    repeat = bits[np.repeat(base[s.text_of], runs) + inner] | np.repeat(s.ids > s.ids[s.first[s.text_of]], runs) if len(runs) else np.zeros(0, bool)
    marks = np.zeros(len(block.data) + length + 1, np.int32)
    places = (np.repeat(s.starts, runs) + inner)[repeat]
    marks[places] += 1
    np.subtract.at(marks, places + length, 1)
    return np.cumsum(marks[: len(block.data)]) > 0


def _rounds(blocks: DataFrame, length: int) -> tuple[DataFrame, int]:
    """Both rounds' answers, and the number of buckets; the second round's are numbered beyond the first's."""
    total = blocks.agg({"n_bytes": "sum"}).first()[0] or 0
    n, width = bucket_count(blocks, total, 8 << 20), key_bytes(total)
    anchors = exchange(blocks, lambda block, _: send_by_bucket(np.unique(_Anchors(block, length).keys), n, width), lambda rows: answer_shared(rows, width), "suffix-anchors")
    texts = exchange(blocks, lambda block, got: _ask_texts(block, got, n, length), lambda rows: _answer_texts(rows, length), "suffix-texts", anchors)
    return anchors.unionByName(texts.withColumn("bucket", (F.col("bucket") + n).cast("int"))), n


def _kept(block: Block, got: dict[int, bytes], n: int, length: int) -> tuple[list[bytes], list[int], list[int]]:
    """Of each document what is left, how many bytes go, and in how many stretches."""
    gone = _removed(block, got, {k - n: v for k, v in got.items() if k >= n}, n, length)
    kept, removed, spans = [], [], []
    for i in range(len(block)):
        a, b = block.offsets[i], block.offsets[i + 1]
        g = gone[a:b]
        kept.append(block.data[a:b][~g].tobytes())
        removed.append(int(g.sum()))
        spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
    return kept, removed, spans


def remove_repeated_bytes(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes long, n_removed long, n_spans long, kept binary), a row for each row of df. length: 8 at least."""
    blocks = pack_blocks(df, id_col, text_col, "suffix-blocks")
    answers, n = _rounds(blocks, length)

    def finish(_: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.Table]:
        kept, removed, spans = _kept(block, got, n, length)
        yield pa.table({id_col: pa.array(block.ids, pa.int64(), mask=block.ids == NO_ID), "n_bytes": pa.array(np.diff(block.offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return per_block(blocks, answers, finish, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated text cut out of text_col, and n_chars, if there is one, counted anew where text went.

    A character of which some byte is removed goes as a whole. Rows whose text was not empty and is now go.
    """
    blocks = pack_blocks(docs, id_col, text_col, "suffix-blocks", whole_rows=True)
    answers, n = _rounds(blocks, length)
    names = docs.columns

    def finish(_: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.Table]:
        kept, _, _ = _kept(block, got, n, length)
        kept = [k if len(k) == e - s else k.decode("utf-8", "ignore").encode() for k, s, e in zip(kept, block.offsets[:-1], block.offsets[1:], strict=True)]
        stays = np.array([len(k) > 0 for k in kept], bool) | (np.diff(block.offsets) == 0)
        yield block.rows(names, text_col, stays, kept, "n_chars")

    return per_block(blocks, answers, finish, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes), whole_rows=True)
