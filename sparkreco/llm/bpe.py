"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Overlapping chunk encoding. A text of up to chunk_chars is pre-tokenised as it is. A longer one is cut into chunks that
overlap, dealt over the cluster and pre-tokenised in parallel; each chunk starts its scan anywhere, perhaps amid a
pre-token. What the pattern matches depends on nothing before the match, so once the scans of two neighbouring chunks share a
boundary they agree from there on: the first shared boundary in the overlap is where the texts are cut, and the pieces between cuts
are encoded on their own. If an overlap has no shared boundary (a run of letters longer than it), the document is
put together again and encoded whole. Decoding concatenates the raw bytes of the ids.

Defined cases: a null or empty text has no ids and decodes to no bytes; a null or repeated id is carried along, a row is a row; a
text in Spark is always valid UTF-8, and every byte has an id, so decoding gives back exactly the text's bytes. Very long texts are
cut into chunks and encoded by several tasks; other columns than the id are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places within this many characters of a cut end may still change with what follows it ('re and the like).
UNSURE = 3


class Codec:
    """Encodes texts as tiktoken would."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = pattern
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    @property
    def scanner(self):
        import regex

        return regex.compile(self.pattern)


@lru_cache(2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def boundaries(scanner, text: str, last: bool) -> np.ndarray:
    """Ends of the matches, without those that what follows a cut end may still change."""
    ends = np.fromiter((m.end() for m in scanner.finditer(text)), np.int32)
    return ends if last else ends[ends <= len(text) - UNSURE]


def _ranks(spark: SparkSession, path: str):
    """The vocabulary file, sent to the executors: its size doesn't depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))))


def _finished(c: Codec, carried: list, texts: Iterator[str], target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about target characters."""
    rows, ids, size = [], [], 0
    for row, text in zip(carried, texts, strict=True):
        rows.append(row)
        ids.append(c.encode(text))
        size += len(text)
        if size >= target:
            yield _batch(c, rows, ids)
            rows, ids, size = [], [], 0
    if rows:
        yield _batch(c, rows, ids)


def _batch(c: Codec, rows: list, ids: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), _lists(ids), pa.array([c.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """(id_col, ids array<int>, decoded binary), a row for each row of df."""
    ranks = _ranks(df.sparkSession, ranks_path)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for b in batches:
            yield from _finished(c, b.column(0).to_pylist(), (x.as_py() for x in b.column(1)))

    short = src.filter(~is_long).mapInArrow(whole, "id long, ids array<int>, decoded binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, i, text in zip(*(b.column(k) for k in range(3)), strict=True):
                row, i, text = row.as_py(), i.as_py(), text.as_py()
                starts = range(0, len(text), chunk_chars)
                for k, s in enumerate(starts):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "id": pa.array([i], pa.int64()), "k": pa.array([k], pa.int32()), "last": [s == starts[-1]], "chunk": [text[s : s + chunk_chars + overlap]]})

    # a row's number only has to be one within this branch, and each chunk carries it
    chunks = src.filter(is_long).select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(cut, "row long, id long, k int, last boolean, chunk string").repartition("row", "k")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = codec(ranks.value, pattern).scanner
        for b in batches:
            heads, tails = [], []
            for last, text in zip(b.column("last"), b.column("chunk"), strict=True):
                ends = boundaries(scanner, text.as_py(), last.as_py())
                heads.append(ends[ends <= overlap])
                tails.append(ends[ends >= chunk_chars] - chunk_chars)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*b.schema.names, "head", "tail"])

    by_place = Window.partitionBy("row").orderBy("k")
    meets = F.array_min(F.array_intersect("tail", F.lead("head").over(by_place)))
    scanned = chunks.mapInArrow(scan, "row long, id long, k int, last boolean, chunk string, head array<int>, tail array<int>")
    placed = scanned.withColumn("end", F.when(~F.col("last"), meets)).withColumn("start", F.when(F.col("k") == 0, 0).otherwise(F.lag("end").over(by_place)))
    placed = placed.select("row", "id", "k", "last", "start", "end", "chunk", F.min(F.when(F.col("last"), True).otherwise(F.col("end").isNotNull())).over(Window.partitionBy("row")).alias("met"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for b in batches:
            x = b.to_pydict()
            ids, left = [], []
            for last, start, end, text, met in zip(x["last"], x["start"], x["end"], x["chunk"], x["met"], strict=True):
                ids.append(c.encode(text[start:] if last else text[start : chunk_chars + end]) if met else [])
                left.append(None if met else text if last else text[:chunk_chars])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("k"), _lists(ids), pa.array(left, pa.string())], ["row", "id", "k", "ids", "left"])

    def stitch(table: pa.Table) -> pa.Table:
        c = codec(ranks.value, pattern)
        x = table.sort_by("k")
        if x.column("left").null_count:
            ids = list(chain.from_iterable(v.as_py() for v in x.column("ids")))
        else:
            ids = c.encode("".join(x.column("left").to_pylist()))
        return pa.Table.from_batches([_batch(c, x.column("id").to_pylist()[:1], [ids])])

    # a chunk may be dealt anew: what Python gets here is a few chunks a batch and no whole document
    long = placed.mapInArrow(pieces, "row long, id long, k int, ids array<int>, left string").groupBy("row").applyInArrow(stitch, "id long, ids array<int>, decoded binary")
    return short.unionByName(long).withColumnRenamed("id", id_col)
