"""SentencePiece encoding and decoding by a table of distinct marked words.

In this kind of vocabulary a marker stands at the beginning of a piece only, so merges never cross the place where a run of markers
begins and the words between such places are segmented one by one. Documents are packed into blocks; a block sends each of its
different words to the bucket of the word's hash, once; a bucket segments each different word of all blocks once and answers with
the ids; the blocks join them back to the words' positions. A word that a third of all texts holds is one entry a block.

The vocabulary file is checked for what the cut rests on (identity normalisation, a marker put before the text, no other piece with
an inner marker), and refused otherwise.

Defined cases: a null or empty text has the begin and end ids alone and decodes to nothing; a null or repeated id is carried along, a row
is a row; an empty table gives no rows; columns beside the two named ones don't matter, whatever they are called. A marker in the
text is a blank to the library, so it decodes to one. A word is encoded in one task, and so is a text without blanks: some 100 bytes of
memory for each of its bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from sparkreco.llm.blocks import NO_ID, Block, bucket_count, exchange, pack_blocks, per_block, squeeze, unsqueeze
from sparkreco.llm.words import MARK, Numbering, gathered, marked_words, numbered_words

#: Bytes of text for which there is a bucket of words, and bytes of a block: the larger, the fewer different words.
BUCKET_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
#: Of compression: disk is dearer here than time.
LEVEL = 9
#: Ids that are decoded at once, if one document has no more.
DECODED = 1 << 16


def check_model(data: bytes) -> None:
    model = sentencepiece_model_pb2.ModelProto.FromString(data)
    spec = model.normalizer_spec
    inner = re.compile(f"[^{MARK}]{MARK}")
    if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model normalises texts in another way than by markers for blanks")
    if model.trainer_spec.model_type != 2 or any(p.type == p.USER_DEFINED or inner.search(p.piece) for p in model.pieces):
        raise ValueError("pieces of the model may cross markers")


class Pieces:
    """Encodes words that begin with a blank as the library encodes them within a text."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.begin, self.end, self.mark = self.model.bos_id(), self.model.eos_id(), self.model.piece_to_id(MARK)

    def encode(self, words: list[str]) -> list[list[int]]:
        # the library puts a marker before the text, which is the word's first blank; it puts none before an empty one
        return [ids if ids else [self.mark] for ids in self.model.encode([w[1:] for w in words], num_threads=1)] if words else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []


@lru_cache(2)
def pieces(data: bytes) -> Pieces:
    return Pieces(data)


def _send(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return squeeze(np.uint32(len(words)).tobytes() + sizes.tobytes() + b"".join(words), LEVEL)


def _read(packed: bytes) -> list[bytes]:
    raw = unsqueeze(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]  # noqa: B905


def _by_bucket(words: list[str], n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words' bytes, their order by bucket and bytes (alike ones side by side, which packs well), and where the buckets start."""
    coded = [w.encode() for w in words]
    bucket = np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) % n
    order = np.array(sorted(range(len(coded)), key=coded.__getitem__), np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    return coded, order, np.searchsorted(bucket[order], np.arange(n + 1))


def encode_and_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """(id_col, ids array<int>, decoded string), a row for each row of df; ids with the begin and end ids.

    packed: ids are binary, little-endian unsigned 32-bit integers one after the other, as token files hold them.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    check_model(data)
    file = df.sparkSession.sparkContext.broadcast(data)  # its size doesn't depend on the data
    kind = np.uint16 if pieces(data).model.get_piece_size() <= 1 << 16 else np.uint32
    blocks = pack_blocks(df, id_col, text_col, name="pieces-blocks", block_bytes=BLOCK_BYTES, bucketed=True, level=LEVEL)
    n = bucket_count(blocks, blocks.agg(F.sum("n_bytes")).first()[0] or 0, BUCKET_BYTES)

    def ask(block: Block, _: dict[int, bytes]) -> dict[int, bytes]:
        coded, order, edges = _by_bucket(numbered_words(block, marked_words)[0], n)
        return {k: _send([coded[i] for i in order[edges[k] : edges[k + 1]].tolist()]) for k in np.flatnonzero(np.diff(edges)).tolist()}

    def answer(rows: list[bytes]) -> list[bytes]:
        numbers = Numbering()
        asked = [np.fromiter(map(numbers.__getitem__, _read(r)), np.int64) for r in rows]
        ids = pieces(file.value).encode([w.decode() for w in numbers])
        sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
        flat, starts = np.fromiter(chain.from_iterable(ids), kind, int(sizes.sum())), np.cumsum(sizes, dtype=np.int64) - sizes
        return [squeeze(sizes[x].tobytes() + flat[gathered(starts, sizes, x)].tobytes(), LEVEL) for x in asked]

    answers = exchange(blocks, ask, answer, "pieces-words", stored=False)

    def assemble(_: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        p = pieces(file.value)
        words, codes, at = numbered_words(block, marked_words)
        _coded, order, edges = _by_bucket(words, n)
        sizes, parts = np.zeros(len(words) + 2, np.int64), []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[k] : edges[k + 1]]
            raw = unsqueeze(got[k])
            sizes[own] = np.frombuffer(raw, np.uint32, len(own))
            parts.append(np.frombuffer(raw, kind, offset=4 * len(own)))
        # what the buckets answered stands in the order of the buckets; the begin and end ids are words of their own behind them
        flat = np.concatenate([*parts, np.array([p.begin, p.end], kind)]).astype(np.int32)
        sizes[-2:] = 1
        starts, placed = np.zeros(len(words) + 2, np.int64), np.concatenate([order, [len(words), len(words) + 1]]).astype(np.int64)
        starts[placed] = np.cumsum(sizes[placed]) - sizes[placed]
        every = np.insert(codes, np.repeat(at, 2)[1:-1], np.tile([len(words), len(words) + 1], len(block)))
        bounds = at + 2 * np.arange(len(block) + 1)
        ids = flat[gathered(starts, sizes, every)]
        ends = np.concatenate([[0], np.cumsum(sizes[every])])[bounds]
        # documents of some thousand ids at a time: what the library takes and gives are Python objects
        cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + DECODED, DECODED))).clip(0, len(block)).tolist()
        for first, last in zip(cuts, cuts[1:]):  # noqa: B905
            own = ends[first : last + 1]
            flat_ids = ids[own[0] : own[-1]]
            decoded = p.decode([ids[a:b].tolist() for a, b in zip(own, own[1:])])  # noqa: B905
            at = pa.array(own - own[0], pa.int32())
            lists = pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, pa.py_buffer((4 * (own - own[0])).astype(np.int32)), pa.py_buffer(flat_ids.astype("<u4"))]) if packed else pa.ListArray.from_arrays(at, pa.array(flat_ids))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[first:last], mask=block.ids[first:last] == NO_ID), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    return per_block(blocks, answers, assemble, f"id long, ids {'binary' if packed else 'array<int>'}, decoded string").withColumnRenamed("id", id_col)
