"""N-gram Jaccard join: documents linked by the similarity of their sets of word shingles, as components.

Documents with equal sets are one class; one of each class goes on. Blocks exchange the hashes of all shingles and learn in
how many classes each occurs. A set can only be linked if enough of its shingles occur elsewhere, and by the prefix
principle linked sets share one of their rarest shingles; sets that share one, directly or by way of others, form a
candidate group. In each group signature trees find the links (signature_tree.py); a large group is cut into parts, and pairs of
parts are tasks of their own, so no task holds more than two parts. Links that join nothing new are not looked for.

Shingles are compared by 64-bit hashes. A link needs 100 * |A & B| >= percent * |A | B|.

Defined cases: A-Z count as a-z; words are the runs between the bytes 0x20 and 0x09 to 0x0D; a text of fewer than n words is one shingle; a null or
empty text has an empty set and no links; a null id counts as larger than all others, and a component of null ids alone has a
null component_id; rows with a repeated id are documents of their own; an empty table gives no rows. Other columns are left out by
jaccard_components and come back as they were from drop_near_copies, whatever their names. A document is one task's work, at some 100
bytes of memory for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreco.llm.blocks import NO_ID, PLACE_BITS, Block, bucket_bounds, bucket_count, exchange, key_bytes, pack_blocks, per_block, squeeze, unsqueeze
from sparkreco.llm.components import connected_components
from sparkreco.llm.hashing import grams, mix
from sparkreco.llm.signature_tree import Linker, Tree, order_sets
from sparkreco.llm.storage import materialize

#: Sets that one part of a candidate group holds at most (about).
PART = 1024


def shingles(block: Block, n: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents' numbers and shingle hashes, sorted by both, each pair once; of the wanted documents."""
    words = block.words(lower=True)
    hashes, inside = words.grams(n)
    owner = words.owner()[: len(hashes)][inside]
    hashes = hashes[inside]
    count = np.diff(words.at)
    for size in range(1, n):  # the whole of a short text
        short = np.flatnonzero(count == size)
        owner = np.concatenate([owner, short])
        hashes = np.concatenate([hashes, grams(words.hashes, size)[words.at[short]]])
    if wanted is not None:
        take = wanted[owner]
        owner, hashes = owner[take], hashes[take]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def _send(keys: np.ndarray, several: np.ndarray, n: int, width: int) -> dict[int, bytes]:
    """Sorted keys by bucket, cut to width bytes, of which the last bit says that the block has the key several times."""
    edges = bucket_bounds(keys, n)
    shift = np.uint64(64 - 8 * width)
    cut = ((keys >> shift) & ~np.uint64(1)) | several.astype(np.uint64)
    raw = cut.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return {k: raw[edges[k] : edges[k + 1]].tobytes() for k in np.flatnonzero(np.diff(edges)).tolist()}


def _frequencies(rows: list[bytes], width: int) -> list[bytes]:
    """For each key of each request in how many classes it occurs: a lower bound, 255 at most, 1 only if it is 1."""
    cut, sizes = [], []
    for r in rows:
        raw = np.frombuffer(r, np.uint8).reshape(-1, width)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, 8 - width :] = raw
        cut.append(full.view(">u8").ravel().astype(np.uint64))
        sizes.append(len(raw))
    both = np.concatenate(cut)
    _, inverse = np.unique(both >> np.uint64(1), return_inverse=True)
    total = np.bincount(inverse, 1 + (both & np.uint64(1)).astype(np.int64))
    found = np.minimum(total, 255).astype(np.uint8)[inverse]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return [squeeze(found[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _place_lists(rows: DataFrame) -> DataFrame:
    """(block, place) rows as an answer with the bucket -1 to each block. A block's list is bounded by the block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x.as_py(), np.int32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-1] * len(lists), pa.int32()), pa.array(lists, pa.binary())], ["block", "bucket", "answer"])

    return rows.groupBy("block").agg(F.collect_list("place")).mapInArrow(pack, "block long, bucket int, answer binary")


def _listed(block: Block, got: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(block), bool)
    out[np.frombuffer(got.get(-1, b""), np.int32)] = True
    return out


def _components(blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each row its block, place, key, id and number of shingles, and its component's least id and the key of the first row that has it."""
    buckets = bucket_count(blocks)
    width = key_bytes(blocks.agg({"n_bytes": "sum"}).first()[0] or 0)

    def digest(b: int, block: Block, _: dict[int, bytes]) -> Iterator[pa.Table]:
        owner, hashes = shingles(block, n)
        starts = np.searchsorted(owner, np.arange(len(block) + 1))
        sums = []
        for salt in (3, 5):
            total = np.concatenate([[0], np.cumsum(mix(hashes * np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64)
            sums.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
        place = np.arange(len(block))
        yield pa.table({"block": pa.array(np.full(len(block), b), pa.int64()), "place": pa.array(place, pa.int32()), "key": pa.array((b << PLACE_BITS) + place, pa.int64()), "id": pa.array(block.ids, pa.int64()), "n": pa.array(np.diff(starts), pa.int64()), "h1": pa.array(sums[0], pa.int64()), "h2": pa.array(sums[1], pa.int64())})

    rows = materialize(per_block(blocks, None, digest, "block long, place int, key long, id long, n long, h1 long, h2 long"), "jaccard-rows")
    classes = rows.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "key")).alias("rep")).select("h1", "h2", "n", F.col("rep.key").alias("rep"))
    known = materialize(rows.join(classes, ["h1", "h2", "n"], "left").select("block", "place", "key", "id", "n", F.coalesce("rep", "key").alias("rep")), "jaccard-classes")

    reps = materialize(_place_lists(known.filter("key = rep AND n > 0").select("block", "place")), "jaccard-reps")

    def ask(block: Block, got: dict[int, bytes]) -> dict[int, bytes]:
        _, hashes = shingles(block, n, _listed(block, got))
        keys, counts = np.unique(hashes, return_counts=True)
        return _send(keys, counts > 1, buckets, width)

    counted = exchange(blocks, ask, lambda asked: _frequencies(asked, width), "jaccard-counts", reps)

    def candidates(b: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.Table]:
        owner, hashes = shingles(block, n, _listed(block, got))
        keys = np.unique(hashes)
        edges = bucket_bounds(keys, buckets)
        often = np.zeros(len(keys), np.uint8)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            often[edges[k] : edges[k + 1]] = np.frombuffer(unsqueeze(got[k]), np.uint8)
        often = often[np.searchsorted(keys, hashes)]
        starts = np.searchsorted(owner, np.arange(len(block) + 1))
        out = {"key": [], "n": [], "shared": [], "tokens": []}
        for i in np.flatnonzero(np.diff(starts)):
            h, f = hashes[starts[i] : starts[i + 1]], often[starts[i] : starts[i + 1]]
            size, shared = len(h), h[f > 1]
            need = -(-percent * size // 100)
            if len(shared) < need:
                continue
            # the rarest size - need + 1 shingles; those that occur nowhere else come first and lead nowhere
            rare = shared[np.lexsort((shared, f[f > 1]))][: len(shared) - need + 1]
            out["key"].append((b << PLACE_BITS) + int(i))
            out["n"].append(size)
            out["shared"].append(shared.tobytes())
            out["tokens"].append(rare.view(np.int64))
        yield pa.table({"key": pa.array(out["key"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "shared": pa.array(out["shared"], pa.binary()), "tokens": pa.array(out["tokens"], pa.list_(pa.int64()))})

    found = materialize(per_block(blocks, reps.unionByName(counted), candidates, "key long, n long, shared binary, tokens array<long>"), "jaccard-candidates")
    tokens = found.select("key", F.explode("tokens").alias("token"))
    least = tokens.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("token", "least")
    groups = connected_components(tokens.join(least, "token").filter("key > least").select(F.col("key").alias("a"), F.col("least").alias("b")), "jaccard-groups")
    links = _links(found.drop("tokens"), groups, percent, buckets)
    label = connected_components(links, "jaccard-links")
    rep_label = known.filter("key = rep").select("rep", "id").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "id", F.coalesce("label", "rep").alias("label"))
    smallest = rep_label.groupBy("label").agg(F.min(F.struct("id", "rep")).alias("least"))
    component = materialize(rep_label.join(smallest, "label").select("rep", F.col("least.id").alias("smallest"), F.col("least.rep").alias("first")), "jaccard-components")
    return known.join(component, "rep").select("block", "place", "key", "id", "n", "smallest", "first")


def jaccard_components(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col long, n_shingles long, component_id long), a row for each row of df."""
    found = _components(pack_blocks(df, id_col, text_col, "jaccard-blocks"), n, percent)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("smallest").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component: the one with the smallest id (of rows with the same id, one). Columns as in docs."""
    blocks = pack_blocks(docs, id_col, text_col, "jaccard-blocks", whole_rows=True)
    gone = _place_lists(_components(blocks, n, percent).filter("key <> first").select("block", "place"))
    names = docs.columns

    def finish(_: int, block: Block, got: dict[int, bytes]) -> Iterator[pa.Table]:
        yield block.rows(names, text_col, ~_listed(block, got))

    return per_block(blocks, materialize(gone, "jaccard-gone"), finish, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes), whole_rows=True)


def _links(found: DataFrame, groups: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Links (a, b) that connect what is connected."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / PART).cast("int")
    members = groups.join(sizes, "label").select(F.col("node").alias("key"), "label", parts.alias("parts")).join(found, "key")
    part = F.pmod(F.xxhash64("key"), "parts").cast("int")
    # small groups share tasks; of a large one each pair of parts is a task
    spread = members.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    spread = spread.withColumn("task", F.when(F.col("parts") == 1, -1 - F.pmod(F.xxhash64("label"), F.lit(4 * buckets))).otherwise(F.col("label")))
    spread = spread.select("task", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "label", "part", "key", "n", "shared")

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("key", "ascending")])
        label, key, size, part = (table.column(c).to_numpy() for c in ("label", "key", "n", "part"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shared")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b = [], []
        bounds = np.flatnonzero(np.diff(np.concatenate([[label[0] - 1], label, [label[-1] + 1]])))
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            linker = Linker(e - s, percent)
            trees = []
            for p in (i,) if i == j else (i, j):
                own = np.flatnonzero(part[s:e] == p)
                if len(own):
                    own = own[order_sets([sets[s + k] for k in own], size[s + own])]
                    trees.append(Tree([sets[s + k] for k in own], size[s + own], own))
            if i == j:
                linker.within(trees[0])
            elif len(trees) == 2:
                linker.between(*trees)
            own = np.flatnonzero(linker.root != np.arange(e - s))
            a.append(key[s + own])
            b.append(key[s + linker.root[own]])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return spread.groupBy("task", "i", "j").applyInArrow(solve, "a long, b long")
