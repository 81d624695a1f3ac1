"""Substring dedup by repeated-phrase automata.

A window is a run of consecutive words. Each window holds an anchor, the phrase of half its length with the least hash, and
equal windows hold it at the same place. Four rounds between the blocks of documents and the buckets of hashes, then a pass:

1. Blocks exchange the hashes of their anchors and learn which recur.
2. They exchange the hashes of the windows around these and learn which may recur; so a phrase that a third of all documents have
   in surroundings of their own costs each block one entry a window, and no bucket gets these surroundings' texts.
3. Runs of windows that may recur, around one anchor, are pieces. Blocks claim theirs by a hash at the anchor's bucket; the first two
   blocks of a piece are chosen to bring its text. A piece that all blocks hold is a text twice, not once a block. A block notes where its
   pieces lie, so that the next round cuts them out and looks for nothing again.
4. The bucket compares the texts' windows word by word and so confirms the recurring passages: its shard. Each block that claimed
   a piece gets the passages in it.
5. Each block compiles the passages of all shards that it shares an anchor with into an Aho-Corasick automaton over words (each two
   characters, from alphabets of their own, so that no state has very many successors) and streams all of its documents through it. Blocks know of no places beforehand: what is removed is what the automaton locates.

A shard's part for a block holds passages around the block's own anchors, so its size is bounded by the block's, and no list of
passages is held in one place. The hashes only leave out what can't recur and say whose text is brought; a false match there costs
work, and the automaton still compares words.

Defined cases: a null or empty text has no words and stays empty; texts shorter than a window keep all words; a null or
repeated id is carried along, each row is a document of its own; other columns are left out, whatever their names; an empty
table gives no rows. A document is one task's work, at some 100 bytes of memory for each of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreco.llm.blocks import NO_ID, Block, Words, answer_shared, bucket_bounds, bucket_count, exchange, key_bytes, minimizers, pack_blocks, per_block, read_bits, send_by_bucket, squeeze, unsqueeze
from sparkreco.llm.hashing import grams, mix


class _Anchors:
    """For each word the place of the anchor of the window from it on, or -1; the anchors' places and keys."""

    def __init__(self, words: Words, window: int):
        size = window // 2 + 1
        hashes, _ = words.grams(size)
        self.place = minimizers(hashes, words.until(window), window - size + 1)
        self.places = np.unique(self.place[self.place >= 0])
        # least hashes are small numbers: mixed anew, they spread over the buckets
        self.keys = mix(hashes[self.places])


def _around(words: Words, got: dict[int, bytes], n: int, window: int) -> tuple[np.ndarray, _Anchors]:
    """Windows (by their first words) around anchors that recur, in this block or beyond."""
    a = _Anchors(words, window)
    keys, inverse, counts = np.unique(a.keys, return_inverse=True, return_counts=True)
    hit = np.zeros(len(words) + 1, bool)
    hit[a.places[((counts > 1) | read_bits(got, keys, n))[inverse]]] = True
    return np.flatnonzero(hit[a.place] & (a.place >= 0)), a


class _Pieces:
    """Runs of windows that may recur, around one anchor: each different word sequence once, in the order of buckets and hashes."""

    def __init__(self, words: Words, got: dict[int, bytes], n: int, window: int):
        places, a = _around(words, got, n, window)
        hashes, _ = words.grams(window)
        keys, inverse, counts = np.unique(hashes[places], return_inverse=True, return_counts=True)
        asked = {k - n: v for k, v in got.items() if n <= k < 2 * n}
        places = places[((counts > 1) | read_bits(asked, keys, n))[inverse]]
        anchor = a.place[places]
        first = np.ones(len(places), bool)
        first[1:] = (places[1:] != places[:-1] + 1) | (anchor[1:] != anchor[:-1])
        begins = np.flatnonzero(first)
        sizes = np.diff(np.append(begins, len(places)))
        starts, ends = places[begins], places[begins] + sizes - 1 + window
        key = a.keys[np.searchsorted(a.places, anchor[begins])]
        # a piece's hash is made of its windows', each with its place
        inner = np.arange(len(places), dtype=np.uint64) - np.repeat(begins, sizes).astype(np.uint64)
        own = mix(np.add.reduceat(mix(hashes[places] + mix(inner)), begins)) if len(begins) else np.empty(0, np.uint64)
        order = np.lexsort((starts, own, key))
        new = np.ones(len(order), bool)
        new[1:] = own[order][1:] != own[order][:-1]
        begins = np.flatnonzero(new)
        chosen = order[begins]
        #: Where the pieces lie in the block's bytes.
        self.spans = np.stack([words.starts[starts[chosen]], words.ends[ends[chosen] - 1]])
        self.several = np.diff(np.append(begins, len(order))) > 1
        self.hashes = own[chosen]
        self.edges = bucket_bounds(key[chosen], n)

    def claims(self) -> dict[int, bytes]:
        return {k: self.hashes[self.edges[k] : self.edges[k + 1]].tobytes() for k in np.flatnonzero(np.diff(self.edges)).tolist()}

    def note(self) -> bytes:
        """For texts(): the buckets and how many pieces each has, then the pieces' hashes, spans and whether there are several."""
        buckets = np.flatnonzero(np.diff(self.edges))
        listed = [np.array([len(buckets), len(self.hashes)]), buckets, np.diff(self.edges)[buckets], self.hashes.view(np.int64), *self.spans]
        return squeeze(b"".join(x.astype(np.int64).tobytes() for x in listed) + self.several.astype(np.uint8).tobytes())


def _texts(data: np.ndarray, note: bytes, chosen: dict[int, bytes]) -> dict[int, bytes]:
    """For each bucket the pieces' hashes, whether the block has them several times, whether it brings their text, and these texts."""
    raw = unsqueeze(note)
    k, m = np.frombuffer(raw, np.int64, 2).tolist()
    buckets, counts, hashes, starts, ends = np.split(np.frombuffer(raw, np.int64, 2 * k + 3 * m, 16), np.cumsum([k, k, m, m]))
    several = np.frombuffer(raw, np.uint8, m, 16 + 8 * (2 * k + 3 * m))
    out, at = {}, 0
    for bucket, size in zip(buckets.tolist(), counts.tolist(), strict=True):
        own = slice(at, at + size)
        brings = np.unpackbits(np.frombuffer(chosen[bucket], np.uint8), count=size)
        lines = b"\n".join(b" ".join(data[starts[i] : ends[i]].tobytes().split()) for i in (at + np.flatnonzero(brings)).tolist())
        out[bucket] = squeeze(struct.pack("<q", size) + hashes[own].tobytes() + several[own].tobytes() + brings.tobytes() + lines)
        at += size
    return out


def _choose(rows: list[bytes]) -> list[bytes]:
    """For each request a bit for each of its pieces: whether this is one of the first two that claim it."""
    lists = [np.frombuffer(r, np.uint64) for r in rows]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")  # of equal ones the requests' order stays
    new = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    first = np.flatnonzero(new)
    chosen = np.empty(len(every), bool)
    chosen[order] = np.arange(len(every)) - first[np.cumsum(new) - 1] < 2
    ends = np.cumsum([len(x) for x in lists])
    return [np.packbits(x).tobytes() for x in np.split(chosen, ends[:-1])]


def _confirm(rows: list[bytes], window: int) -> list[bytes]:
    """For each request the confirmed passages in its pieces: runs of windows whose words start elsewhere too; one a line."""
    claimed: Counter[int] = Counter()
    brought: dict[int, list[bytes]] = {}
    asked = []
    for r in rows:
        raw = unsqueeze(r)
        m = struct.unpack_from("<q", raw)[0]
        hashes = np.frombuffer(raw, np.uint64, m, 8).tolist()
        several, brings = np.frombuffer(raw, np.uint8, m, 8 + 8 * m).tolist(), np.frombuffer(raw, np.uint8, m, 8 + 9 * m).tolist()
        asked.append(hashes)
        for h, more in zip(hashes, several, strict=True):
            claimed[h] += 1 + more
        for h, line in zip([h for h, b in zip(hashes, brings, strict=True) if b], raw[8 + 10 * m :].split(b"\n"), strict=False):
            texts = brought.setdefault(h, [])
            if line not in texts:
                texts.append(line)
    known: dict[bytes, int] = {}
    ids, sizes, times, lines = [], [], [], []
    for h, texts in brought.items():
        for line in texts:
            own = [known.setdefault(w, len(known)) for w in line.split(b" ")]
            ids += own
            sizes.append(len(own))
            times.append(claimed[h])
            lines.append(line)
    ids, sizes, times = np.array(ids, np.int64), np.array(sizes), np.array(times, np.int64)
    windows = sizes - window + 1
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    places = np.repeat(np.cumsum(sizes) - sizes, windows) + inner
    weight = np.repeat(times, windows)
    keys = grams(mix(ids.astype(np.uint64)), window)[places]
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    a, b = places[order][:-1][~new[1:]], places[order][1:][~new[1:]]
    same = np.ones(len(a), bool)
    for k in range(window):
        same &= ids[a + k] == ids[b + k]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weight[order]).astype(np.int64)
    recurs = np.empty(len(order), bool)
    recurs[order] = total[group] > 1
    for g in np.unique(group[1:][~new[1:]][~same]).tolist():  # one hash, several word sequences
        own = order[group == g]
        exact = [tuple(ids[p : p + window].tolist()) for p in places[own]]
        found = Counter()
        for e, w in zip(exact, weight[own].tolist(), strict=True):
            found[e] += w
        recurs[own] = [found[e] > 1 for e in exact]
    # runs of confirmed windows within a piece
    piece = np.repeat(np.arange(len(sizes)), windows)[recurs]
    at = inner[recurs]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
    passages: dict[int, list[bytes]] = {}
    for p, s, e in zip(piece[first].tolist(), at[first].tolist(), (at[np.append(first[1:], True)[: len(at)]] + window).tolist(), strict=True):
        passages.setdefault(p, []).append(b" ".join(lines[p].split(b" ")[s:e]))
    of_hash: dict[int, list[bytes]] = {}
    number = 0
    for h, texts in brought.items():
        for _ in texts:
            of_hash.setdefault(h, []).extend(passages.get(number, []))
            number += 1
    return [squeeze(b"\n".join(dict.fromkeys(x for h in hashes for x in of_hash[h]))) for hashes in asked]


def automaton(passages: list[str]) -> ahocorasick.Automaton:
    """The compiled passages, two characters a word."""
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in passages:
        out.add_word(p)
    out.make_automaton()
    return out


#: What stands for a word that no passage holds, and the first character of the alphabets.
OTHER, LETTERS = "\0\0", 0x100


def _coded(passages: set[bytes]) -> tuple[dict[bytes, str], list[str]]:
    """Two characters for each word, of an alphabet for the first and one for the second; and the passages in them."""
    listed = b" \n ".join(passages).split(b" ")
    numbers = dict.fromkeys([b"\n", *listed])
    base = isqrt(len(numbers)) + 1
    letters = [chr(k if k < 0xD800 else k + 0x800) for k in range(LETTERS, LETTERS + 2 * base)]
    code = {w: letters[k // base] + letters[base + k % base] for k, w in enumerate(numbers)}
    return code, "".join(map(code.__getitem__, listed)).split(code[b"\n"])


def _located(words: Words, got: dict[int, bytes], window: int) -> np.ndarray:
    """Words covered by what the automaton of the shards' passages locates in the block's documents."""
    covered = np.zeros(len(words) + 1, np.int64)
    passages = {line for packed in got.values() for line in unsqueeze(packed).split(b"\n") if line}
    if passages:
        code, coded = _coded(passages)
        shard = automaton(coded)
        for s, e in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True):
            if e - s >= window:
                own = words.data[words.starts[s] : words.ends[e - 1]].tobytes().split()
                for end, size in shard.iter("".join(map(code.get, own, repeat(OTHER)))):
                    last = s + end // 2 + 1
                    covered[last - size // 2] += 1
                    covered[last] -= 1
    return np.cumsum(covered[:-1]) > 0


def remove_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words long, n_removed long, kept string): the words not covered by a window that also starts elsewhere, joined by one blank."""
    blocks = pack_blocks(df, id_col, text_col, "repeats-blocks")
    total = blocks.agg({"n_bytes": "sum"}).first()[0] or 0
    n, width = bucket_count(blocks, total, 8 << 20), key_bytes(total)

    def ask_anchors(block: Block, _: dict[int, bytes]) -> dict[int, bytes]:
        return send_by_bucket(np.unique(_Anchors(block.words(), window).keys), n, width)

    def ask_windows(block: Block, got: dict[int, bytes]) -> dict[int, bytes]:
        words = block.words()
        places, _ = _around(words, got, n, window)
        return send_by_bucket(np.unique(words.grams(window)[0][places]), n, width)

    def ask_claims(block: Block, got: dict[int, bytes]) -> dict[int, bytes]:
        pieces = _Pieces(block.words(), got, n, window)
        note = pieces.note()
        return pieces.claims() | {-1 - (zlib.crc32(note) >> 1): note}

    def ask_texts(block: Block, got: dict[int, bytes]) -> dict[int, bytes]:
        return _texts(block.data, next(v for k, v in got.items() if k < 0), {k: v for k, v in got.items() if k >= 0})

    def later(answers: DataFrame, k: int) -> DataFrame:
        """Answers of round k, their buckets numbered on."""
        return answers.withColumn("bucket", (F.col("bucket") + k * n).cast("int"))

    answers = exchange(blocks, ask_anchors, lambda rows: answer_shared(rows, width), "repeats-anchors")
    answers = answers.unionByName(later(exchange(blocks, ask_windows, lambda rows: answer_shared(rows, width), "repeats-windows", answers), 1))
    claimed = exchange(blocks, ask_claims, _choose, "repeats-claims", answers)
    passages = exchange(blocks, ask_texts, lambda rows: _confirm(rows, window), "repeats-passages", claimed, stored=False)

    def finish(_: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.Table]:
        words = block.words()
        removed = _located(words, got, window)
        owner = words.owner()
        kept, pieces = np.flatnonzero(~removed), []
        text, offsets = _gather(words, kept)
        bounds = np.searchsorted(kept, words.at)
        for i in range(len(block)):
            a, b = bounds[i], bounds[i + 1]
            pieces.append(text[offsets[a] : offsets[b] - 1] if b > a else b"")
        yield pa.table(
            {
                id_col: _ids(block.ids),
                "n_words": pa.array(np.diff(words.at), pa.int64()),
                "n_removed": pa.array(np.bincount(owner[removed], minlength=len(block)), pa.int64()),
                "kept": pa.array(pieces, pa.binary()).cast(pa.string()),
            }
        )

    return per_block(blocks, passages, finish, f"`{id_col}` long, n_words long, n_removed long, kept string")


def _ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def _gather(words: Words, chosen: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chosen words, a blank after each, and where each starts, and the end."""
    starts, sizes = words.starts[chosen], words.ends[chosen] - words.starts[chosen]
    offsets = np.zeros(len(chosen) + 1, np.int64)
    np.cumsum(sizes + 1, out=offsets[1:])
    source = np.repeat(starts - offsets[:-1], sizes + 1) + np.arange(offsets[-1])
    out = words.data[np.minimum(source, max(0, len(words.data) - 1))] if len(chosen) else np.zeros(0, np.uint8)
    out[offsets[1:] - 1] = 32
    return out.tobytes(), offsets
