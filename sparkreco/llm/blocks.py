"""Blocks of documents and exchanges of packed keys between them.

Operators that compare all documents by their content (shingles, byte windows, word windows, vocabularies) pack documents
into blocks of a bounded number of bytes: one row holds a compressed payload. A block sends each hash bucket one
packed request, a bucket answers all blocks at once, and the answers meet the payload again by the block's number. A key that
a third of all documents hold costs one entry a block and not one row a document, no group of documents is gathered
anywhere, and no row is expanded into pairs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkreco.llm.hashing import LOWER, grams, span_hashes, word_spans
from sparkreco.llm.storage import materialize

#: Bytes of text after which a block is closed; a longer document makes a block of its own.
BLOCK_BYTES = 3 << 19
#: A document's key is its block's number and its place in the block, of so many bits.
PLACE_BITS = 19
MOST_DOCS = 1 << PLACE_BITS
NO_ID = np.iinfo(np.int64).max


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Block:
    """ids: int64 (a null id: the largest there is); offsets: where each text starts in data, and the end; flags: what the caller marked."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, flags: np.ndarray, extra: bytes | None = None):
        self.ids, self.offsets, self.data, self.flags, self.extra = ids, offsets, data, flags, extra

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def pack(self, level: int = 3) -> bytes:
        return squeeze(struct.pack("<q", len(self.ids)) + self.ids.tobytes() + self.offsets.tobytes() + self.flags.tobytes() + self.data.tobytes(), level)

    @classmethod
    def unpack(cls, payload: bytes, extra: bytes | None = None) -> Block:
        raw = unsqueeze(payload)
        n = struct.unpack_from("<q", raw)[0]
        ids = np.frombuffer(raw, np.int64, n, 8)
        offsets = np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n)
        flags = np.frombuffer(raw, np.uint8, n, 16 + 16 * n)
        return cls(ids, offsets, np.frombuffer(raw, np.uint8, offset=16 + 17 * n), flags, extra)

    def rows(self, columns: list[str], text_col: str, keep: np.ndarray, texts: list[bytes] | None = None, counted: str = "") -> pa.Table:
        """The kept rows with all columns of the packed table; texts: new ones, of which the column `counted` gets the lengths."""
        table = pa.ipc.open_stream(unsqueeze(self.extra)).read_all()
        # by place: a column of any name may be there; the last says which texts are null
        null = table.column(table.num_columns - 1).to_numpy()
        out = {c: table.column(k).combine_chunks() for k, c in enumerate(c for c in columns if c != text_col)}
        if texts is None:
            out[text_col] = pa.array([None if null[i] else self.text(i) for i in range(len(self))], pa.binary()).cast(pa.string())
        else:
            strings = [t.decode("utf-8", "ignore") for t in texts]
            out[text_col] = pa.array([None if null[i] else t for i, t in enumerate(strings)], pa.string())
            if counted in out:
                changed = np.array([len(t) for t in texts]) != np.diff(self.offsets)
                out[counted] = pc.if_else(pa.array(changed), pa.array([len(t) for t in strings]).cast(out[counted].type), out[counted])
        return pa.table({c: out[c] for c in columns}).filter(pa.array(keep))

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The document of each place in data."""
        return np.searchsorted(self.offsets, places, side="right") - 1

    def words(self, lower: bool = False) -> Words:
        return Words(self, LOWER[self.data] if lower else self.data)


class Words:
    """The words of a block's texts: where they start and end in data, their hashes, and at[i] to at[i + 1] those of document i."""

    def __init__(self, block: Block, data: np.ndarray):
        starts, ends = word_spans(data)
        inner = np.unique(block.offsets[1:-1])
        k = np.searchsorted(starts, inner, side="right") - 1
        if len(starts):  # texts lie side by side: words end where their text ends
            inner = inner[(k >= 0) & (starts[np.maximum(k, 0)] < inner) & (ends[np.maximum(k, 0)] > inner)]
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        self.data, self.starts, self.ends = data, starts, ends
        self.at = np.searchsorted(starts, block.offsets, side="left")
        self.hashes = span_hashes(data, starts, ends)

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words from each word on, and which of them lie within one document."""
        h = grams(self.hashes, n)
        return h, self.until(n)[: len(h)]

    def until(self, n: int) -> np.ndarray:
        """For each word, whether n words from it on belong to its document."""
        last = np.repeat(self.at[1:], np.diff(self.at))
        return np.arange(len(self)) + n <= last

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


BLOCK_SCHEMA = "block long, n_docs int, n_bytes long, payload binary, extra binary"


def pack_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "blocks", block_bytes: int | None = None, flag: Column | None = None, whole_rows: bool = False, bucketed: bool = False, level: int = 3) -> DataFrame:
    """Pack (id, text, flag) rows into blocks, written to shared storage: block numbers stay the same for every later job.

    whole_rows: all other columns are packed too, and Block.rows() gives them back. bucketed: the files are bucketed by block, so
    that answers come to the blocks and the blocks don't move again. level: of compression.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 24, 0
        ids: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        extras: list[pa.RecordBatch] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = count = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, flags, sizes, parts, extras, held, count
            size = np.concatenate(sizes)
            offsets = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=offsets[1:])
            block = Block(np.concatenate(ids), offsets, np.concatenate(parts), np.concatenate(flags))
            sink = pa.BufferOutputStream()
            if whole_rows:
                with pa.ipc.new_stream(sink, extras[0].schema) as stream:
                    for x in extras:
                        stream.write_batch(x)
            out = pa.RecordBatch.from_pydict({"block": [base + seq], "n_docs": pa.array([len(block)], pa.int32()), "n_bytes": pa.array([int(offsets[-1])], pa.int64()), "payload": [block.pack(level)], "extra": pa.array([squeeze(sink.getvalue().to_pybytes()) if whole_rows else None], pa.binary())})
            seq, ids, flags, sizes, parts, extras, held, count = seq + 1, [], [], [], [], [], 0, 0
            return out

        for batch in batches:
            own = pc.fill_null(batch.column(0).cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False)
            offsets, data = text_bytes(batch.column(1))
            marked = batch.column(2).cast(pa.uint8()).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(own):
                # as many rows as still fit, one at least
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes - held, side="right")) - 1)
                upto = min(upto, len(own), at + MOST_DOCS - count)
                ids.append(own[at:upto])
                flags.append(marked[at:upto])
                if whole_rows:
                    extras.append(pa.RecordBatch.from_arrays(batch.columns[3:], names).slice(at, upto - at))
                sizes.append(np.diff(offsets[at : upto + 1]))
                parts.append(data[offsets[at] : offsets[upto]])
                held += int(offsets[upto] - offsets[at])
                count += upto - at
                at = upto
                if held >= block_bytes or count == MOST_DOCS:
                    yield flush()
        if ids:
            yield flush()

    block_bytes = block_bytes or BLOCK_BYTES
    names = [*(c for c in df.columns if c != text_col), "__null"] if whole_rows else []
    others = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names[:-1])] + [F.col(f"`{text_col}`").isNull().alias("__null")] * whole_rows
    flagged = F.coalesce(F.lit(False) if flag is None else flag, F.lit(False)).alias("__flag")
    return materialize(df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"), flagged, *others).mapInArrow(pack, BLOCK_SCHEMA), name, "block" if bucketed else None)


def bucket_count(blocks: DataFrame, total: int = 0, bucket_bytes: int = 4 << 20) -> int:
    """Buckets of an exchange: as many as there are shuffle partitions; given the bytes of all texts, enough for bucket_bytes each."""
    return max(8, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))


#: What a block asks: for each bucket, bytes. What a bucket answers: for each block, bytes.
Ask = Callable[[Block, dict[int, bytes]], dict[int, bytes]]
Answer = Callable[[list[bytes]], list[bytes]]


def _grouped_rows(table: pa.Table, name: str) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column(name).to_pylist(), strict=True))


def _with_answers(blocks: DataFrame, answers: DataFrame | None, fn: Callable[[int, Block, dict[int, bytes]], Iterator[pa.RecordBatch] | Iterator[pa.Table]], schema: str, whole_rows: bool = False) -> DataFrame:
    """Run fn over each block, with the answers that it got."""
    columns = ["block", "payload", *["extra"] * whole_rows]
    if answers is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, *packed in zip(*batch.columns, strict=True):
                    for out in fn(b.as_py(), Block.unpack(*(x.as_py() for x in packed)), {}):
                        yield from [out] if isinstance(out, pa.RecordBatch) else out.to_batches()

        return blocks.select(*columns).mapInArrow(alone, schema)

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got = _grouped_rows(right, "answer")
        tables = [empty]
        for b, *packed in zip(*(left.column(c) for c in columns), strict=True):
            for out in fn(b.as_py(), Block.unpack(*(x.as_py() for x in packed)), got):
                tables.append(pa.Table.from_batches([out]) if isinstance(out, pa.RecordBatch) else out)
        return pa.concat_tables(tables)

    return blocks.select(*columns).groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(both, schema)


def per_block(blocks: DataFrame, answers: DataFrame | None, fn: Callable[[int, Block, dict[int, bytes]], Iterator[pa.Table]], schema: str, whole_rows: bool = False) -> DataFrame:
    """fn over each block with its answers; Block.rows() works with whole_rows."""
    return _with_answers(blocks, answers, fn, schema, whole_rows)


def exchange(blocks: DataFrame, ask: Ask, answer: Answer, name: str, answers: DataFrame | None = None, summary: Callable[[list[bytes]], bytes] | None = None, stored: bool = True) -> DataFrame:
    """One round: ask() of each block (with the answers of an earlier round, if any), answer() of each bucket.

    Returns (block, bucket, answer), written to shared storage (unless told not to: for answers that are read once); with summary,
    each bucket also has a row with block -1.
    """

    def asks(b: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.Table]:
        out = ask(block, got)
        yield pa.table({"block": pa.array([b] * len(out), pa.int64()), "bucket": pa.array(list(out), pa.int32()), "ask": pa.array(list(out.values()), pa.binary())})

    def answers_of(table: pa.Table) -> pa.Table:  # a bucket below 0 holds notes of blocks to themselves
        rows = table.column("ask").to_pylist()
        said = rows if table.column("bucket").to_pylist()[0] < 0 else answer(rows)
        who, bucket = table.column("block").to_pylist(), table.column("bucket").to_pylist()[0]
        if summary and bucket >= 0:
            said, who = [*said, summary(rows)], [*who, -1]
        return pa.table({"block": pa.array(who, pa.int64()), "bucket": pa.array([bucket] * len(who), pa.int32()), "answer": pa.array(said, pa.binary())})

    requests = _with_answers(blocks, answers, asks, "block long, bucket int, ask binary")
    answered = requests.groupBy("bucket").applyInArrow(answers_of, "block long, bucket int, answer binary")
    return materialize(answered, name) if stored else answered


def tree_merge(rows: DataFrame, merge: Callable[[list[bytes]], bytes], width: int = 16) -> list[bytes]:
    """merge() the states of rows (part long, state binary), width parts at a time, until the driver gets width of them at most."""

    def some(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")  # sums of fractions depend on the order
        return pa.table({"part": table.column("part").slice(0, 1), "at": table.column("at").slice(0, 1), "state": pa.array([merge(table.column("state").to_pylist())], pa.binary())})

    most = rows.agg(F.max("part")).first()[0] or 0
    while most >= width:
        rows = rows.withColumn("at", F.col("part")).withColumn("part", F.expr(f"part div {width}")).groupBy("part").applyInArrow(some, "part long, at long, state binary").drop("at")
        most //= width
    return [r["state"] for r in rows.orderBy("part").select("state").collect()]


#: Bytes of a hash that are sent where a false match only costs work, for so many bytes of text.
def key_bytes(total: int) -> int:
    return min(8, max(5, -(-(max(1, total).bit_length() + 10) // 8)))


def send_keys(keys: np.ndarray, width: int) -> bytes:
    """The high bytes of sorted keys."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def read_keys(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def send_by_bucket(keys: np.ndarray, n: int, width: int) -> dict[int, bytes]:
    """Sorted keys as requests."""
    edges = bucket_bounds(keys, n)
    return {k: send_keys(keys[edges[k] : edges[k + 1]], width) for k in np.flatnonzero(np.diff(edges)).tolist()}


def answer_shared(rows: list[bytes], width: int) -> list[bytes]:
    """For each request a bit for each of its keys: whether another request has it too."""
    lists = [read_keys(r, width) for r in rows]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    # a truncated key may stand twice in one request: count requests, not entries
    if width < 8:
        again = np.concatenate([x[1:][x[1:] == x[:-1]] for x in lists])
        if len(again):
            np.subtract.at(counts, np.searchsorted(values, again), 1)
            # such a key stands for several; it counts as shared
            counts[np.searchsorted(values, np.unique(again))] += 1
    many = counts > 1
    return [np.packbits(many[np.searchsorted(values, x)]).tobytes() for x in lists]


def read_bits(got: dict[int, bytes], keys: np.ndarray, n: int) -> np.ndarray:
    """The answered bits in the order of the sorted keys that were sent."""
    edges = bucket_bounds(keys, n)
    out = np.zeros(len(keys), bool)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        size = int(edges[k + 1] - edges[k])
        out[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=size).astype(bool)
    return out


def minimizers(hashes: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """For each place i the place of the least of the w hashes from i on (the last one, among equals); -1 where not valid[i].

    Equal windows have their least hash at the same place, whatever surrounds them.
    """
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # the low bits give way to the place, so that a running minimum carries it; places count downwards. As many bits for all blocks:
    # where hashes agree in the rest, equal windows still choose alike
    bits = 32
    packed = (hashes >> np.uint64(bits) << np.uint64(bits)) | (np.uint64(len(hashes)) - np.arange(len(hashes), dtype=np.uint64))
    least, span = packed, 1
    while span * 2 <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[:n], least[w - span : w - span + n])
    place = len(hashes) - (least[:n] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.where(valid[:n], place, -1)


def split_buckets(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by bucket (the high bits, scaled) and value; the sorted keys; n + 1 bounds of the buckets."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, keys, bucket_bounds(keys, n)


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket starts in sorted keys, and the end; bucket k holds the keys from k * 2^64 / n on."""
    edges = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges, side="left"), [len(keys)]])
