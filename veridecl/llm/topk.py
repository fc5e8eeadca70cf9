"""Exact top-k search by inner product: a Voronoi join with bounds from group summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

#: Pivots of the Voronoi cells: a quarter of the square root of the number of vectors, between these. At most MOST_PIVOTS
#: vectors and summaries of cells come to the driver.
LEAST_PIVOTS, MOST_PIVOTS = 64, 1024
#: Bytes of the vectors whose scores give a query its first bound: distinct vectors with the smallest hashes.
WITNESS_BYTES = 4 << 20
#: Queries of one group at most, and about how many distinct vectors meet them in one task.
GROUP, SLOT = 4096, 16_384
_LIMIT = float(1 << 52)
LONG = (1 << 63) - 1


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as a double; null where the vector, or a component, is null or not finite."""
    scaled = F.transform(vector, lambda x: F.lit(256.0) * x.cast("double"))
    # doubles from 2**52 up are whole
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < _LIMIT, F.floor(x).cast("double")).otherwise(x))
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as 64-bit integers; Python's integers where doubles would round, clamped to a long."""
    if not queries.size or not data.size:
        return np.zeros((len(queries), len(data)), np.int64)
    if np.abs(queries).max() * np.abs(data).max() * queries.shape[1] < _LIMIT:
        return (queries @ data.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(exact(queries) @ exact(data).T, -LONG - 1, LONG).astype(np.int64)


def _cells(pivots: np.ndarray):
    """The nearest pivot of each vector and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (pivots**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("v"))
            cell = (squares - 2 * m @ pivots.T).argmin(axis=1)
            away = np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _least_ids(k: int):
    """Of each vector in a batch only its k smallest ids: no other row of that vector can be among a query's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, list[int]] = {}
            rows = {}
            m = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, 0))
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                key = m[i].tobytes()
                rows.setdefault(key, i)
                best.setdefault(key, []).append(vec_id)
            if rows:
                first = pa.array(list(rows.values()))
                ids = [sorted(set(best[key]))[:k] for key in rows]
                yield pa.RecordBatch.from_arrays([batch.column("v").take(first), pa.array(ids, pa.list_(pa.int64()))], names=["v", "ids"])

    return run


def _bounds(pivots: np.ndarray, radii: np.ndarray, witnesses: list, k: int):
    """Of each query the least that its k best scores reach, and the cells that can hold one of them."""
    ids = [r["ids"] for r in witnesses]
    vectors = np.array([r["v"] for r in witnesses], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("v"))
            floors = []
            for vec_id, line in zip(batch.column("vec_id").to_pylist(), _scores(m, vectors)):
                found = sorted((int(s) for s, own in zip(line, ids) for x in own if x != vec_id), reverse=True)
                floors.append(found[k - 1] if len(found) >= k else -LONG - 1)
            # q.x = q.p + q.(x - p) <= q.p + |q| * radius
            reach = m @ pivots.T + np.sqrt((m**2).sum(axis=1))[:, None] * (radii * (1 + 1e-9) + 1e-6)[None, :]
            reach += np.abs(reach) * 1e-9 + 1e-6
            wanted = [np.flatnonzero(line >= low).tolist() for line, low in zip(reach, floors)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64()), pa.array(wanted, pa.list_(pa.int32()))], names=[*batch.schema.names, "floor", "wanted"])

    return run


def _solve(k: int, pivots: int):
    """The k best of one slot of data for every query of one group, over the cells that the query wants."""

    def run(asked: pa.Table, data: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if asked.num_rows and data.num_rows:
            asked, data = asked.combine_chunks(), data.combine_chunks()
            one = lambda t, c: t.column(c).chunk(0)
            q, x = _matrix(one(asked, "v")), _matrix(one(data, "v"))
            query_ids, floors = one(asked, "vec_id").to_pylist(), one(asked, "floor").to_numpy()
            wanted = np.zeros((len(q), pivots), bool)
            for line, cells in zip(wanted, one(asked, "wanted").to_pylist()):
                line[cells] = True
            members, cells = one(data, "ids").to_pylist(), one(data, "cell").to_numpy()
            for cell in np.unique(cells):
                rows, asks = np.flatnonzero(cells == cell), np.flatnonzero(wanted[:, cell])
                for begin in range(0, len(asks), 256):
                    some = asks[begin : begin + 256]
                    for i, line in zip(some.tolist(), _scores(q[some], x[rows])):
                        keep = np.flatnonzero(line >= floors[i])
                        if len(keep) > k + 1:
                            # one row may be the query's own; ties at the cut stay and are decided by id
                            cut = np.partition(line[keep], len(keep) - k - 1)[len(keep) - k - 1]
                            keep = keep[line[keep] >= cut]
                        found = sorted((-int(line[r]), v) for r in keep.tolist() for v in members[rows[r]] if v != query_ids[i])[:k]
                        out += [(query_ids[i], v, -s) for s, v in found]
        return pa.table({n: pa.array([r[c] for r in out], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def _top_k_of_length(data: DataFrame, asked: DataFrame, length: int, k: int) -> DataFrame:
    least = data.mapInArrow(_least_ids(k + 1), "v array<double>, ids array<long>").groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    distinct = materialize(least, "vectors")
    many = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(distinct.count() ** 0.5 / 4)))
    first = distinct.orderBy(F.xxhash64("v"), "v").limit(max(many, min(1024, WITNESS_BYTES // (8 * length)))).collect()
    pivots = np.array([r["v"] for r in first[:many]], np.float64)
    cells = materialize(distinct.mapInArrow(_cells(pivots), "v array<double>, ids array<long>, cell int, away double"), "cells")
    summary = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # one row a pivot
    radii = np.array([summary[c]["radius"] if c in summary else 0.0 for c in range(len(pivots))])
    # data go to tasks by units: small cells together, large ones in several slots
    unit, filled, unit_of, slots = 0, 0, {}, {}
    for cell in sorted(summary, key=lambda c: float(pivots[c] @ pivots[0])):  # like cells next to each other
        if filled and filled + summary[cell]["n"] > SLOT:
            unit, filled = unit + 1, 0
        unit_of[cell], filled = unit, filled + summary[cell]["n"]
        slots[unit] = -(-filled // SLOT)
    number = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    placed = asked.mapInArrow(_cells(pivots), "vec_id long, v array<double>, cell int, away double").drop("away")
    placed = materialize(placed.mapInArrow(_bounds(pivots, radii, first, k), "vec_id long, v array<double>, cell int, floor long, wanted array<int>"), "queries")
    group, filled, groups = 0, 0, {}
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    for cell in sorted(sizes, key=lambda c: float(pivots[c] @ pivots[0])):  # like cells next to each other
        if filled and filled + sizes[cell] > GROUP:
            group, filled = group + 1, 0
        split = -(-sizes[cell] // GROUP)
        groups[cell] = (group, split)
        group, filled = (group + split, 0) if split > 1 else (group, filled + sizes[cell])
    if not groups:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    table, splits = number({c: g for c, (g, _) in groups.items()}), number({c: n for c, (_, n) in groups.items()})
    placed = placed.withColumn("g", (table[F.col("cell")] + F.pmod(F.xxhash64("vec_id"), splits[F.col("cell")])).cast("int")).drop("cell")

    # a query goes only to the units that hold a cell that it wants, and a cell only to groups that want it
    units, sizes = number(unit_of), number(slots)
    need = placed.select((F.col("g") + 0).alias("to"), F.explode("wanted").alias("cell")).distinct()
    sent = cells.withColumn("unit", units[F.col("cell")]).select("v", "ids", "cell", "unit", F.pmod(F.xxhash64("v", F.lit(7)), sizes[F.col("unit")]).cast("int").alias("at")).join(need, "cell")
    spread = placed.withColumn("unit", F.explode(F.array_distinct(F.transform("wanted", lambda c: units[c]))))
    spread = spread.withColumn("slot", F.explode(F.sequence(F.lit(0), sizes[F.col("unit")] - 1)))
    found = spread.groupBy("g", "unit", "slot").cogroup(sent.groupBy("to", "unit", "at")).applyInArrow(_solve(k, len(pivots)), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of ``vectors`` with the highest score for each row of ``queries``: query_id, rank, vec_id, score.

    Both tables have vec_id and embedding. Each component x counts as floor(256 * x); the score is the integer inner
    product; ties go to the smaller vec_id; a query's own vec_id is no candidate. Vectors that are null, empty of
    components, or hold null or non-finite components take no part, nor do rows without a vec_id. Vectors of different
    lengths are not compared. Repeated rows count once. If fewer than k candidates exist, all are returned; an empty
    table gives no rows. Scores beyond 64 bits are clamped. Further columns are ignored.

    The data are grouped in Voronoi cells around pivots. A summary of each cell (radius, and the scores of a few
    members) bounds what a query must at least find and what a cell can at most give; a query is sent only to cells
    that can still matter, where it is solved locally. Equal vectors are one row with their smallest ids.
    """
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).filter("v is not null and size(v) > 0 and vec_id is not null").dropDuplicates(["vec_id", "v"])
    data, asked = clean(vectors), clean(queries)
    out = None
    for (length,) in sorted(data.select(F.size("v")).distinct().collect()):
        part = _top_k_of_length(data.filter(F.size("v") == length), asked.filter(F.size("v") == length), length, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out
