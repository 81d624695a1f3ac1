"""Exact top-k inner products by a Voronoi kNN join.

Vectors are turned into whole numbers. One more component, sqrt(M^2 - |x|^2) for data and 0 for queries, turns the largest inner
product into the smallest Euclidean distance: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Pivots cut the space into cells. Each cell's summary
holds the number of its rows, its radius and the least distances from its pivot; from the summaries alone follows, for each cell of
queries, an upper bound on the distance of the k-th answer, and from that which rows of each data cell can still be
among the answers. Only these rows go to the groups of query cells; each group's share of the data is dealt in blocks, solved by
matrix products, and the partial answers are merged.

Defined cases: rows with a null id, a null vector, or a null or non-finite component take no part; an empty vector's
products are 0; vectors of different lengths count as filled up with zeros; rows with a repeated id are rows of their own, as queries
and as candidates, so a query may meet another row with its own id, but never itself; ties go to the smaller id; other columns
are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreco.llm.storage import materialize

#: Queries in a group, and data rows in a block, at most (about): what one task holds at once.
GROUP_QUERIES, BLOCK_ROWS = 1024, 16384


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float, is_query: Column) -> DataFrame:
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"), is_query.alias("q"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products: by floating point where all sums are exact there, else by integers."""
    most = (int(np.abs(q).max(initial=0)) or 1) * (int(np.abs(x).max(initial=0)) or 1) * max(1, q.shape[1])
    return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < 1 << 53 else q @ x.T


def _best(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query row's k highest (all, if fewer): query rows, rows, ids, scores."""
    order = np.lexsort((rows, ids))  # among equal scores the first is the one with the smaller id
    rows, ids, x = rows[order], ids[order], x[order]
    scores = _products(q, x)
    own = q_rows[:, None] == rows[None, :]
    out = []
    for i in range(len(q_rows)):
        s, free = scores[i], np.flatnonzero(~own[i])
        if len(free) > 4 * k:
            least = np.partition(s[free], len(free) - k)[len(free) - k]
            free = free[s[free] >= least]
        top = free[np.argsort(-s[free], kind="stable")[:k]]
        out.append((np.full(len(top), q_rows[i]), rows[top], ids[top], s[top]))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*out, strict=True)) or [[], [], [], []]))


def knn_join(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int | None = None) -> DataFrame:
    """(query_id long, rank int, id_col long, score long) for each row of df that is_query holds for, over all other rows.

    pivots: how many; by default the root of the number of rows, from 64 to 1,024, so that the summaries stay small for the driver.
    """
    spark = df.sparkSession
    schema = f"query_id long, rank int, `{id_col}` long, score long"
    src = whole_vectors(df, id_col, vector_col, scale, F.coalesce(is_query, F.lit(False)))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    known = src.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("v")).alias("dim")).first()
    if not known["n"]:
        return spark.createDataFrame([], schema)
    dim, top = int(known["dim"]), float(known["norm"]) + 1.0
    pivots = pivots or int(min(1024, max(64, known["n"] ** 0.5)))
    chosen = src.select("v").orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    points = np.zeros((len(chosen), dim + 1))
    for i, r in enumerate(chosen):
        points[i, : len(r["v"])] = r["v"]
    points[:, dim] = np.sqrt(np.maximum(0, top - (points**2).sum(1)))
    points = np.unique(points, axis=0)
    sent = spark.sparkContext.broadcast(points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            x = _matrix(b.column("v"), dim).astype(float)
            size = (x**2).sum(1)
            cells = []
            for extra in (np.sqrt(np.maximum(0, top - size)), np.zeros(len(x))):
                d2 = (size + extra**2)[:, None] + (p**2).sum(1)[None, :] - 2 * (x @ p[:, :dim].T + extra[:, None] * p[None, :, dim])
                cell = d2.argmin(1) if len(x) else np.zeros(0, int)
                cells += [pa.array(cell, pa.int32()), pa.array(np.sqrt(np.maximum(0, d2[np.arange(len(x)), cell])), pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cells], ["id", "v", "q", "cell", "dist", "q_cell", "q_dist"])

    placed = src.mapInArrow(assign, "id long, v array<long>, q boolean, cell int, dist double, q_cell int, q_dist double")
    # written with its number, a row keeps it whatever is read again
    rows = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "knn-cells")
    return _join(rows, points, dim, k, id_col, schema)


def _join(rows: DataFrame, points: np.ndarray, dim: int, k: int, id_col: str, schema: str) -> DataFrame:
    spark = rows.sparkSession
    n_cells = len(points)
    nearest = Window.partitionBy("cell").orderBy("dist")
    count, radius = np.zeros(n_cells, np.int64), np.full(n_cells, -1.0)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect():
        count[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    near = [[] for _ in range(n_cells)]
    for r in rows.select("cell", "dist", F.row_number().over(nearest).alias("i")).filter(F.col("i") <= k + 1).collect():
        near[r["cell"]].append(r["dist"])
    q_count, q_radius = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    for r in rows.filter("q").groupBy("q_cell").agg(F.count("*").alias("n"), F.max("q_dist").alias("far")).collect():
        q_count[r["q_cell"]], q_radius[r["q_cell"]] = r["n"], r["far"]
    # a query's own row is no answer, so of k + 1 rows within a bound k are answers at least
    between = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * points @ points.T))
    slack = 1e-6 * (1 + float(np.sqrt((points**2).sum(1).max())))
    least = np.full((n_cells, n_cells), np.inf)  # [query cell, data cell]: rows nearer to their pivot are no answers
    for i in np.flatnonzero(q_count):
        reach = np.sort(np.concatenate([q_radius[i] + between[i, j] + np.array(near[j]) for j in range(n_cells) if near[j]]))
        bound = reach[k] if len(reach) > k else np.inf
        limit = between[i] - q_radius[i] - bound - slack
        least[i] = np.where((count > 0) & (limit <= radius), limit, np.inf)
    # groups of query cells that lie near each other; a cell with many queries makes several groups
    order = np.argsort(points @ (points[0] - points[-1]), kind="stable")
    first, parts, limits, held = np.zeros(n_cells, int), np.ones(n_cells, int), [], GROUP_QUERIES
    for i in order:
        if not q_count[i]:
            continue
        if q_count[i] > GROUP_QUERIES:
            parts[i] = -(-q_count[i] // GROUP_QUERIES)
            first[i] = len(limits)
            limits += [least[i]] * parts[i]
            held = GROUP_QUERIES
        elif held + q_count[i] > GROUP_QUERIES:
            first[i], held = len(limits), q_count[i]
            limits.append(least[i])
        else:
            first[i], held = len(limits) - 1, held + q_count[i]
            limits[-1] = np.minimum(limits[-1], least[i])
    if not limits:
        return spark.createDataFrame([], schema)
    blocks = max(1, -(-int(count.sum()) // BLOCK_ROWS))
    plan = spark.sparkContext.broadcast((np.array(limits), first, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, _, _ = plan.value
        for b in batches:
            cell, dist = b.column("cell").to_numpy(), b.column("dist").to_numpy()
            salt = pa.array((b.column("row").to_numpy() * np.int64(2654435761) >> np.int64(16)) % blocks, pa.int64())
            for g in range(len(limits)):
                take = pa.array(np.flatnonzero(dist >= limits[g, cell]))
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), g), pa.int32()), salt.take(take), *(b.column(c).take(take) for c in ("row", "id", "v"))], ["g", "salt", "row", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = plan.value
        for b in batches:
            cell = b.column("q_cell").to_numpy()
            g = first[cell] + b.column("row").to_numpy() % parts[cell]
            for salt in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(np.full(len(g), salt), pa.int64()), *(b.column(c) for c in ("row", "id", "v"))], ["g", "salt", "row", "id", "v"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = (_matrix(t.column("v").combine_chunks(), dim) for t in (left, right))
        found = _best(left.column("row").to_numpy(), q, right.column("row").to_numpy(), right.column("id").to_numpy(), x, k) if len(q) and len(x) else (np.zeros(0, np.int64),) * 4
        query = dict(zip(left.column("row").to_pylist(), left.column("id").to_pylist(), strict=True))
        ids = pa.array([query[r] for r in found[0].tolist()], pa.int64())
        return pa.table(dict(zip(("query_row", "row", "id", "score"), (pa.array(c, pa.int64()) for c in found), strict=True)) | {"query_id": ids})

    kind = "g int, salt long, row long, id long, v array<long>"
    data = rows.select("row", "id", "v", "cell", "dist").mapInArrow(deal, kind)
    queries = rows.filter("q").select("row", "id", "v", "q_cell").mapInArrow(ask, kind)
    partial = queries.groupBy("g", "salt").cogroup(data.groupBy("g", "salt")).applyInArrow(solve, "query_row long, row long, id long, score long, query_id long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row"))
    return partial.select("query_id", rank.cast("int").alias("rank"), F.col("id").alias(id_col), "score").filter(F.col("rank") <= k)
