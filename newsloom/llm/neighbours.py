"""Approximate nearest neighbours by cosine over an inverted multi-index.

Unit vectors are cut into two halves; k-means on a bounded sample (``SAMPLE`` vectors)
quantises each half, and a vector's cell is its pair of centroids.  Every vector is
indexed.  A query walks the pairs of centroids in the order of their summed distance
with a heap until it has met enough vectors; what the cells hold is then compared
exactly on the original vectors, in double precision.

How many vectors are enough is measured: for at most ``CALIBRATION`` of the queries the
true neighbours are found among all vectors, and the walk goes as far as
``RECALL`` of those need.  On vectors without structure that is a large part of all.

Equal vectors are one entry of the index with the ids it needs (the smallest k + 1), and
equal queries are answered once.  Cells are dealt to blocks of at most ``BLOCK`` entries
(a fuller cell is split), and queries to chunks, so that a task holds one block and one
chunk whatever the data.

Vectors that are null, zero, empty, or hold null or non-finite components take no part,
nor do rows without id or with another number of components than most; a repeated row
counts once.  Ties go to the smaller id.  With no valid query or vector the result is
empty; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SAMPLE = 20_000
CALIBRATION = 256
RECALL = 0.96
BLOCK = 20_000
CHUNK = 10_000
MOST_CENTROIDS = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = squared(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        count = np.bincount(nearest, minlength=k)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


class Codebook:
    def __init__(self, sample: np.ndarray, n: int):
        self.k = int(min(MOST_CENTROIDS, len(sample), max(8, round(np.sqrt(n) / 3.5))))
        self.half = max(1, sample.shape[1] // 2)
        unit = units(sample)
        self.first, self.second = kmeans(unit[:, : self.half], self.k), kmeans(unit[:, self.half :], self.k)

    @classmethod
    def of(cls, state: dict) -> Codebook:
        """From the attributes, which are plain values that any worker can read."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(unit[:, : self.half], self.first), squared(unit[:, self.half :], self.second)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.distances(units(vectors))
        return a.argmin(1) * self.k + b.argmin(1)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells in the order of first[i] + second[j], until they hold ``enough`` entries."""
    k = len(first)
    i_order, j_order = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[i_order].tolist(), second[j_order].tolist()
    heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heappop(heap)
        cell = i_order[i] * k + j_order[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        if j + 1 < k:
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < k:
            heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v, d1, d2 of the vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    used = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: F.coalesce(fine(x), F.lit(False)))
        & F.exists("v", lambda x: x != 0)
    )
    sizes = used.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    if sizes is None:
        return used.withColumns({"d1": F.lit(0).cast("long"), "d2": F.lit(0).cast("long")})
    return used.filter(F.size("v") == sizes["s"]).withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(7), "v")})


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest finite scores of each row, and of all that tie with the last."""
    if scores.shape[1] > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        return np.nonzero((scores >= floor - 1e-12) & np.isfinite(scores))
    return np.nonzero(np.isfinite(scores))


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which ``is_query`` holds."""
    session, keep = vectors.sparkSession, k + 1
    rows = cut(valid(vectors))
    order = Window.partitionBy("d1", "d2").orderBy("vec_id")
    least = rows.select("d1", "d2", "vec_id", "v").distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep)
    entries = least.groupBy("d1", "d2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    entries = cut(entries)
    queries = rows.filter(is_query).select("d1", "d2", F.col("vec_id").alias("query_id")).distinct()
    wanted = cut(queries.select("d1", "d2").distinct().join(entries.select("d1", "d2", "v"), ["d1", "d2"]))
    n, n_queries = entries.count(), wanted.count()
    empty = session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n or not n_queries:
        return empty
    by_hash = lambda df, m: matrix(df.orderBy(F.xxhash64("d1", "d2")).limit(m).select("v").toArrow()["v"].combine_chunks())
    book = Codebook(by_hash(entries, SAMPLE), n)
    shared_book = session.sparkContext.broadcast(vars(book))

    def place(source):
        book = Codebook.of(shared_book.value)
        for batch in source:
            if batch.num_rows:
                cells = book.cells(matrix(batch.column("v")))
                yield batch.append_column("cell", pa.array(cells, pa.int32()))

    placed = cut(entries.mapInArrow(place, "d1 long, d2 long, ids array<long>, v array<double>, cell int"))
    counts = np.zeros(book.k**2, np.int64)
    for cell, count in placed.groupBy("cell").count().collect():
        counts[cell] = count
    enough = max(keep + 1, calibrate(placed, by_hash(wanted, CALIBRATION), book, counts, keep))

    block, of_cell = 0, {}
    held = 0
    for cell in np.flatnonzero(counts).tolist():
        if held and held + counts[cell] > BLOCK:
            block, held = block + 1, 0
        parts = -(-int(counts[cell]) // BLOCK)
        of_cell[cell] = (block, parts)
        held += int(counts[cell])
        if parts > 1:
            block, held = block + parts, 0
    chunks = -(-n_queries // CHUNK)
    plan = session.sparkContext.broadcast((of_cell, counts, enough, chunks))

    def deal_entries(source):
        of_cell, _, _, chunks = plan.value
        for batch in source:
            cells = batch.column("cell").to_pylist()
            d1 = batch.column("d1").to_pylist()
            blocks = pa.array([of_cell[c][0] + h % of_cell[c][1] for c, h in zip(cells, d1)], pa.int32())
            part = batch.select(["ids", "v", "cell"]).append_column("block", blocks)
            for chunk in range(chunks):
                yield part.append_column("chunk", pa.array([chunk] * batch.num_rows, pa.int32()))

    def deal_queries(source):
        of_cell, counts, enough, chunks = plan.value
        book, listed = Codebook.of(shared_book.value), counts.tolist()
        for batch in source:
            if not batch.num_rows:
                continue
            a, b = book.distances(units(matrix(batch.column("v"))))
            row, blocks, cells = [], [], []
            for r in range(batch.num_rows):
                met: dict[int, list[int]] = {}
                for cell in walk(a[r], b[r], listed, enough):
                    first, parts = of_cell[cell]
                    for p in range(parts):
                        met.setdefault(first + p, []).append(cell)
                for k, v in met.items():
                    row.append(r)
                    blocks.append(k)
                    cells.append(v)
            d1 = batch.column("d1").to_pylist()
            for at in range(0, len(row), 2000):  # bounded output
                some = pa.array(row[at : at + 2000], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(some) for c in ("d1", "d2", "v")),
                        pa.array(cells[at : at + 2000], pa.list_(pa.int32())),
                        pa.array(blocks[at : at + 2000], pa.int32()),
                        pa.array([d1[r] % chunks for r in row[at : at + 2000]], pa.int32()),
                    ],
                    names=["d1", "d2", "v", "cells", "block", "chunk"],
                )

    def compare(index: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"d1": [], "d2": [], "vec_id": [], "score": []}
        if index.num_rows and asked.num_rows:
            v, q = matrix(index["v"].combine_chunks()), matrix(asked["v"].combine_chunks())
            vn, qn = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
            names, column = np.unique(index["cell"].to_numpy(), return_inverse=True)
            ids = index["ids"].to_pylist()
            met, d1, d2 = asked["cells"].to_pylist(), asked["d1"].to_pylist(), asked["d2"].to_pylist()
            for at in range(0, len(q), 128):
                seen = np.zeros((len(q[at : at + 128]), len(names)), bool)
                for r, cells in enumerate(met[at : at + 128]):
                    seen[r, np.searchsorted(names, np.intersect1d(cells, names))] = True
                scores = q[at : at + 128] @ v.T / vn / qn[at : at + 128, None]
                scores[~seen[:, column]] = -np.inf
                row, col = best(scores, keep)
                row += at
                exact = (q[row] * v[col]).sum(1) / (qn[row] * vn[col])
                for r, c, s in zip(row.tolist(), col.tolist(), exact.tolist()):
                    for i in ids[c]:
                        out["d1"].append(d1[r])
                        out["d2"].append(d2[r])
                        out["vec_id"].append(i)
                        out["score"].append(s)
        return pa.table(
            {k: pa.array(x, pa.float64() if k == "score" else pa.int64()) for k, x in out.items()}
        )

    dealt = placed.select("d1", "ids", "v", "cell").mapInArrow(
        deal_entries, "ids array<long>, v array<double>, cell int, block int, chunk int"
    )
    asked = wanted.repartition("d1").mapInArrow(
        deal_queries, "d1 long, d2 long, v array<double>, cells array<int>, block int, chunk int"
    )
    found = (
        dealt.groupBy("block", "chunk")
        .cogroup(asked.groupBy("block", "chunk"))
        .applyInArrow(compare, "d1 long, d2 long, vec_id long, score double")
    )
    nearest = Window.partitionBy("d1", "d2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= keep)
    own = found.join(queries, ["d1", "d2"]).filter("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy("r")
    return own.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(placed: DataFrame, q: np.ndarray, book: Codebook, counts: np.ndarray, keep: int) -> int:
    """How many entries a walk must meet so that RECALL of the sampled queries' true neighbours are among them."""
    shared = placed.sparkSession.sparkContext.broadcast(units(q))

    def nearest(source):
        for batch in source:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            scores = shared.value @ units(matrix(batch.column("v"))).T
            row, col = best(scores, keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int32()), pa.array(scores[row, col]), pa.array(cells[col])], names=["q", "score", "cell"]
            )

    order = Window.partitionBy("q").orderBy(F.desc("score"))
    true = placed.mapInArrow(nearest, "q int, score double, cell int").withColumn("r", F.row_number().over(order))
    pairs = np.array([(r.q, r.cell) for r in true.filter((F.col("r") <= keep) & (F.col("r") > 1)).collect()], np.int64)
    if not len(pairs):
        return keep
    a, b = book.distances(units(q))
    total = (a[:, :, None] + b[:, None, :]).reshape(len(q), -1)
    order = np.argsort(total, axis=1, kind="stable")
    met = np.cumsum(counts[order], axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.sort(met[pairs[:, 0], place[pairs[:, 0], pairs[:, 1]]])
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])
