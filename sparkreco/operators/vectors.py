"""An inverted file over unit vectors: cells, bounds from their radii, exact and probed search.

Each vector belongs to the cell of its nearest centre and is stored in that cell's folder. Of a cell the widest angle between its
centre and a vector is known, so no cosine with a query exceeds that of the angle that is left: a search reads the nearest cells of
each query first, and then, to be exact, those that could still hold a better one than the k-th best. A probed search leaves the second step out.

Queries and parts are dealt to tasks, which multiply matrices: a part is several cells, and a large cell is as many parts as it needs. A
query goes to each part once, with the cells that it visits there, however many these are: where bounds prune little, queries move once
a part and vectors once a group of queries. Centres (some thousands at most, by a parameter) are what moves to all tasks. They
only steer: results don't depend on them in an exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreco.functions.scalar import normalized
from sparkreco.operators.signals import top_per_group
from sparkreco.operators.sinks import stage

#: Rows of a part of a cell and of a part of the queries, at least; rows that the centres are taken from, a centre.
PART_ROWS, QUERY_ROWS, SAMPLE_ROWS = 1 << 14, 1 << 15, 64
#: Parts grow up to so many rows while there are as many of them: a query moves once a part.
MOST_ROWS, PARTS = 1 << 16, 12
#: Numbers of a product, and candidates that are kept before they are cut to the best.
PRODUCT, CANDIDATES = 1 << 21, 1 << 21
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))

def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of which a matrix with so many columns is at most PRODUCT numbers; none, if it has no columns."""
    step = min(1024, max(1, PRODUCT // max(1, width)))
    for b in batches:
        for a in range(0, len(b) if width else 0, step):
            # copied, so that lists begin at their own offset
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, step)]) if a == 0 and len(b) <= step else c.take(pa.array(np.arange(a, min(a + step, len(b))))) for c in b.columns], b.schema.names)


def _first_k(row: np.ndarray, cosine: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest cosines, ties to the smaller item, by row."""
    order = np.lexsort((item, -cosine, row))
    r = row[order]
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    at = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    return order[at < k]


def best_of_part(left: pa.Table, right: pa.Table, k: int, digits: int) -> list[np.ndarray]:
    """query_id, item_id, cosine and compared, as _solved has them, of queries (query_id, qv, least, cells) and vectors (item_id, v, cell).

    Products are made cell by cell, with the queries that visit it. Of each query the lowest cosine is kept that can still be one of its k
    best: only what reaches it is rounded and put in order.
    """
    right = right.sort_by([("cell", "ascending"), ("item_id", "ascending")])
    qi, items, rows, vectors = left.column("query_id").to_numpy(), right.column("item_id").to_numpy(), _matrix(left.column("qv")), _matrix(right.column("v"))
    margin = 0.5 * 10.0**-digits + SLACK
    floor = left.column("least").combine_chunks().fill_null(-2.0).to_numpy(zero_copy_only=False) - margin
    listed = left.column("cells").combine_chunks()
    visitor, cell = np.repeat(np.arange(len(qi)), np.diff(listed.offsets.to_numpy())), listed.flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    visitor, cell = visitor[order], cell[order]
    own = right.column("cell").to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    compared, some = np.zeros(len(qi), np.int64), np.full(len(qi), -1)
    kept, n = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], 0

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, cosine, at = (np.concatenate(c) for c in zip(*kept, strict=True))
        best = _first_k(row, cosine, items[at], k)
        row, cosine, at = row[best], cosine[best], at[best]
        full = np.flatnonzero(np.concatenate([row[k - 1 :] == row[: len(row) - k + 1], np.zeros(min(k - 1, len(row)), bool)])) if len(row) >= k else np.zeros(0, np.int64)
        np.maximum.at(floor, row[full], cosine[full + k - 1] - margin)
        return row, cosine, at

    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = np.searchsorted(cell, own[lo], "left"), np.searchsorted(cell, own[lo], "right")
        for start in range(a, b, max(1, PRODUCT // (hi - lo))):
            who = visitor[start : min(b, start + max(1, PRODUCT // (hi - lo)))]
            cosines = rows[who] @ vectors[lo:hi].T
            ends = [np.searchsorted(items[lo:hi], qi[who], side) for side in ("left", "right")]
            for i in np.flatnonzero(ends[1] > ends[0]).tolist():
                cosines[i, ends[0][i] : ends[1][i]] = -np.inf  # the query itself
            compared[who] += hi - lo
            fresh = np.flatnonzero(floor[who] < -1.5)
            if len(fresh) and hi - lo > k:
                kth = np.partition(cosines[fresh], hi - lo - k, axis=1)[:, hi - lo - k]
                floor[who[fresh]] = np.maximum(floor[who[fresh]], kth - 2 * margin)
            i, j = np.nonzero(cosines >= np.maximum(floor[who], -2.0)[:, None])
            kept.append((who[i], np.round(cosines[i, j], digits) + 0.0, lo + j))
            # a row of each query carries what it compared, even if none reaches its floor
            new = np.flatnonzero(some[who] < 0)
            some[who[new]] = np.where(cosines[new, 0] > -2, lo, np.where(cosines[new, -1] > -2, hi - 1, -1))
            n += len(i)
            if n > CANDIDATES:
                kept = [cut()]
                n = len(kept[0][0])
    row, cosine, at = cut()
    none = np.setdiff1d(np.flatnonzero(some >= 0), row)
    row, at = np.concatenate([row, none]), np.concatenate([at, some[none]])
    cosine = np.concatenate([cosine, np.round((rows[none] * vectors[some[none]]).sum(1), digits) + 0.0])
    first = np.unique(row, return_index=True)[1]
    counts = np.zeros(len(row), np.int64)
    counts[first] = compared[row[first]]
    return [qi[row], items[at], cosine, counts]


def centres_of(rows: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Unit centres of a sample: spherical k-means from evenly spaced rows."""
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(rows[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """vectors: (item_id, v, cell), stored by cell. cells: (cell, n, radius, centre), a row for each cell that has vectors; radius in radians."""

    vectors: DataFrame
    cells: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, most_cells: int = 4096, seed: int = 42) -> VectorIndex:
        """Of (item_id, vector); a vector that is null or has no length isn't in it. As many cells as the root of the rows, most_cells at most."""
        spark = vectors.sparkSession
        rows = vectors.select("item_id", normalized("vector").alias("v")).filter("v IS NOT NULL")
        n = rows.count()
        n_cells = max(1, min(most_cells, round(n**0.5)))
        share = min(1.0, SAMPLE_ROWS * n_cells / max(1, n))  # by a hash: the same rows however the table is dealt
        sample = rows.filter(F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("item_id").toPandas()
        centres = centres_of(np.stack(sample["v"].to_list()), n_cells) if len(sample) else np.zeros((1, 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    cosines = _matrix(b.column("v")) @ centres.T
                    own = cosines.argmax(1)
                    angle = np.arccos(np.clip(cosines[np.arange(len(own)), own], -1, 1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(angle)], ["item_id", "v", "cell", "angle"])

        placed = rows.mapInArrow(assign, "item_id long, v array<double>, cell int, angle double")
        # dealt by cell and place, so that a large cell is written by many tasks and a small one as one file
        placed.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(max(1, n // (PART_ROWS * n_cells))))).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
        stored = spark.read.schema("item_id long, v array<double>, angle double, cell int").parquet(f"{folder}/vectors")
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).join(F.broadcast(known), "cell").select("cell", "n", "radius", "centre").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        return cls(spark.read.schema("item_id long, v array<double>, angle double, cell int").parquet(f"{folder}/vectors").drop("angle"), spark.read.schema("cell int, n long, radius double, centre array<double>").parquet(f"{folder}/cells"))

    def _layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, radii and centres of the cells, and of each its group of cells, and of each group how many parts it is; bounded by most_cells."""
        cells = self.cells.orderBy("cell").toPandas()
        centres = np.stack(cells["centre"].to_list()) if len(cells) else np.zeros((0, 1))
        most = max(PART_ROWS, min(MOST_ROWS, int(cells["n"].sum()) // PARTS))
        group, parts, filled = [], [], most
        for n in cells["n"].tolist():
            if filled + n > most:
                parts.append(max(1, -(-n // most)))
                filled = 0
            filled += n
            group.append(len(parts) - 1)
        return cells["cell"].to_numpy(), cells["radius"].to_numpy(), centres, np.array(group, np.int64), np.array(parts, np.int64)

    def _nearest(self, queries: DataFrame, probes: int, layout: tuple) -> DataFrame:
        """(query_id, qv, near): the probes nearest cells of each query, by their places in the layout."""
        centres = layout[2]

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, len(centres)):
                far = -(_matrix(b.column("qv")) @ centres.T)
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(near.reshape(-1), np.full(len(b), near.shape[1]))], ["query_id", "qv", "near"])

        return queries.mapInArrow(nearest, "query_id long, qv array<double>, near array<int>")

    def _visits(self, asked: DataFrame, bound: bool, layout: tuple, digits: int) -> DataFrame:
        """(query_id, qv, least, grp, cells): of each group of cells those that the query visits: near ones, or with bound all others that may hold a cosine of at least `least`."""
        ids, radius, centres, group, _ = layout

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, len(ids)):
                near = np.zeros((len(b), len(ids)), bool)
                listed = b.column("near")
                near[np.repeat(np.arange(len(b)), np.diff(listed.offsets.to_numpy())), listed.flatten().to_numpy()] = True
                if bound:
                    angles = np.arccos(np.clip(_matrix(b.column("qv")) @ centres.T, -1, 1))
                    best = np.cos(np.maximum(angles - radius - SLACK, 0))
                    least = b.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
                    near = ~near & (best >= least[:, None] - 0.5 * 10.0**-digits - SLACK)
                row, cell = np.nonzero(near)  # by query, then by cell: cells of a group follow each other
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[cell[1:]] != group[cell[:-1]])])) if len(row) else np.zeros(0, np.int64)
                at = pa.array(row[starts])
                cells = _lists(ids[cell], np.diff(np.append(starts, len(row))))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("qv").take(at), b.column("least").take(at), pa.array(group[cell[starts]].astype(np.int32)), cells], ["query_id", "qv", "least", "grp", "cells"])

        return asked.mapInArrow(visits, "query_id long, qv array<double>, least double, grp int, cells array<int>")

    def _solved(self, visits: DataFrame, k: int, layout: tuple, digits: int) -> DataFrame:
        """(query_id, item_id, cosine, compared): the k best of each query and part, of those that reach the query's `least`; compared: rows that the query met there, on one row each."""
        spark, (ids, _, _, group, parts) = visits.sparkSession, layout
        known = F.broadcast(spark.createDataFrame(list(enumerate(parts.tolist())), "grp int, parts int"))
        home = F.broadcast(spark.createDataFrame(list(zip(ids.tolist(), group.tolist(), strict=True)), "cell int, grp int"))
        most = F.greatest(F.lit(QUERY_ROWS), F.least(F.lit(MOST_ROWS), F.floor(F.count("*") / PARTS)))
        asked = visits.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias("qparts"))
        sizes = F.broadcast(asked.join(known, "grp"))  # a row a group
        q = visits.join(sizes, "grp").withColumn("qpart", F.pmod(F.xxhash64("query_id"), "qparts").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        v = self.vectors.join(home, "cell").join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("item_id"), "parts").cast("int")).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))

        def solve(left: pa.Table, right: pa.Table) -> pa.Table:
            columns = best_of_part(left, right, k, digits) if len(left) and len(right) else [np.zeros(0)] * 4
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "item_id", "cosine", "compared"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})

        keys = ["grp", "part", "qpart"]
        return q.select("query_id", "qv", "least", "cells", *keys).groupBy(*keys).cogroup(v.select("item_id", "v", "cell", *keys).groupBy(*keys)).applyInArrow(solve, "query_id long, item_id long, cosine double, compared long")

    def found(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, digits: int = 4) -> DataFrame:
        """(query_id, item_id, cosine, compared) of (item_id, vector) queries: more than the k best; see _solved."""
        layout = self._layout()
        q = queries.select(F.col("item_id").alias("query_id"), normalized("vector").alias("qv")).filter("qv IS NOT NULL")
        asked = self._nearest(q, probes, layout)
        if exact:
            asked = asked.persist()  # one list of near cells for both steps: what the first has read the second leaves out
        first = self._solved(self._visits(asked.withColumn("least", F.lit(None).cast("double")), False, layout, digits), k, layout, digits)
        if not exact:
            return first
        first = stage(first, "found")  # read for the k-th best, and for the result; what moved for it goes
        kth = top_per_group(first, ["query_id"], [F.desc("cosine"), F.asc("item_id")], k, "at").filter(F.col("at") == k).select("query_id", F.col("cosine").alias("least"))
        rest = self._visits(asked.join(kth, "query_id", "left"), True, layout, digits)
        return first.unionByName(self._solved(rest, k, layout, digits))

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, most: int = 256, digits: int = 4) -> int:
        """How many cells must be probed to find such a share of the k best, measured on about `most` of the queries (by a hash) against the exact search."""
        share = min(1.0, most / max(1, queries.count()))
        some = queries.filter(F.pmod(F.xxhash64("item_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
        best = self.search(some, k, digits=digits).select("query_id", "item_id").join(self.vectors.select("item_id", "cell"), "item_id")
        cells = self.cells.orderBy("cell").toPandas()  # bounded by most_cells
        if not len(cells):
            return 1
        centres, at = np.stack(cells["centre"].to_list()), {c: i for i, c in enumerate(cells["cell"].tolist())}

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    order = np.argsort(np.argsort(-(_matrix(b.column("qv")) @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
                    yield pa.RecordBatch.from_pydict({"place": order[np.arange(len(b)), [at[c] for c in b.column("cell").to_pylist()]]})

        asked = some.select(F.col("item_id").alias("query_id"), normalized("vector").alias("qv")).filter("qv IS NOT NULL")
        found = best.join(asked, "query_id").select("qv", "cell").mapInArrow(places, "place long").groupBy("place").count().orderBy("place").collect()  # no more places than cells
        upto, total = 0, sum(r["count"] for r in found)
        for r in found:
            upto += r["count"]
            if upto >= recall * total:
                return r["place"] + 1
        return 1

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, digits: int = 4) -> DataFrame:
        """(query_id, item_id, cosine, rank): the k items with the highest rounded cosine for each of a stated set of queries, without the query itself.

        Among equal cosines the smaller id comes first. probes: cells that are read before the bounds are known; the only ones, if not exact.
        """
        return top_per_group(self.found(queries, k, probes, exact, digits).drop("compared"), ["query_id"], [F.desc("cosine"), F.asc("item_id")], k)
