"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by separate codebooks; a pair of centroids is a
cell.  A query walks the cells by the sum of its two halves' distances, with a heap, until
the cells hold a set share of all entries.  Those entries are scored exactly.

Codebooks are fitted on a bounded sample of the vectors, and so is the share: it is the
smallest of ``SHARES`` that reaches ``recall`` on sample queries.  Equal vectors are one
entry that keeps its smallest ids, as many as a query can return.

The cells of one first centroid form a shelf, which is cut into blocks of bounded size.
Queries go to the blocks of the shelves they visit, with a bit for each cell of the shelf, so
that a dense cell is shared out among tasks and scoring is one matrix product a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpoint

SAMPLE = 20_000
SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9, 1.0)
#: entries of a cell that the number of centroids aims at, ids of a block, and queries for which a task keeps its best candidates before it hands them on
PER_CELL, BLOCK, HELD = 16, 1024, 20_000


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = distances(x, centres).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def cells_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = (distances(h, c).argmin(axis=1) for h, c in zip(halves(x), books, strict=True))
    return a * len(books[1]) + b


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in the order of summed distance, until they hold ``enough`` entries.  Empty cells are passed over."""
    i_of, j_of = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    x, y, width = left[i_of].tolist(), right[j_of].tolist(), len(right)
    i_of, j_of = i_of.tolist(), j_of.tolist()
    heap, reached, cells, got = [(x[0] + y[0], 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = i_of[i] * width + j_of[j]
        if n := int(counts[cell]):
            cells.append(cell)
            got += n
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(x) and b < len(y) and (a, b) not in reached:
                reached.add((a, b))
                heapq.heappush(heap, (x[a] + y[b], a, b))
    return cells


def share_needed(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, queries: int = 200) -> float:
    """The smallest share of entries that gives the recall on queries taken from the sample."""
    if len(sample) <= k + 1:
        return 1.0
    cell = cells_of(sample, books)
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    own = np.arange(0, len(sample), max(1, len(sample) // queries))[:queries]
    picked = sample[own]
    scores = picked @ sample.T
    scores[np.arange(len(own)), own] = -np.inf  # a query is no neighbour of its own
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    left, right = (distances(h, c) for h, c in zip(halves(picked), books, strict=True))
    for share in SHARES:
        found = [np.isin(cell[b], walk(x, y, counts, int(np.ceil(share * len(sample))))).mean() for b, x, y in zip(best, left, right, strict=True)]
        if np.mean(found) >= recall:
            return share
    return 1.0


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the ``k`` largest of each row, ties to the smaller id; -inf is no score."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        row, column = np.nonzero(scores > -np.inf)
    found, score = ids[row, column], scores[row, column]
    order = np.lexsort((found, -score, row))
    row, found, score = row[order], found[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], found[keep], score[keep]


class Best:
    """The ``k`` best candidates so far of each query that a task has met."""

    def __init__(self, k: int):
        self.k, self.place = k, {}
        self.ids, self.scores = np.zeros((0, k), np.int64), np.zeros((0, k))

    def places(self, queries: np.ndarray) -> np.ndarray:
        at = np.array([self.place.setdefault(q, len(self.place)) for q in queries.tolist()], np.int64)
        if (more := len(self.place) - len(self.ids)) > 0:
            more = max(more, len(self.ids))  # grows by doubling
            self.ids = np.concatenate([self.ids, np.zeros((more, self.k), np.int64)])
            self.scores = np.concatenate([self.scores, np.full((more, self.k), -np.inf)])
        return at

    def meet(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        at = self.places(queries)
        better = np.flatnonzero((scores >= self.scores[at, -1:]).any(axis=1) & (scores > -np.inf).any(axis=1))
        at = at[better]
        both = np.concatenate([self.scores[at], scores[better]], axis=1)
        names = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
        row, found, score = best_of(both, names, self.k)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.scores[at] = -np.inf
        self.ids[at[row], place], self.scores[at[row], place] = found, score

    def rows(self) -> pa.RecordBatch:
        names = np.array(list(self.place), np.int64)
        row, column = np.nonzero(self.scores[: len(names)] > -np.inf)
        return pa.record_batch([pa.array(names[row]), pa.array(self.ids[row, column]), pa.array(self.scores[row, column])], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.94, centroids: int | None = None) -> DataFrame:
    """The ``k`` nearest other rows, by inner product, of each row for which ``is_query`` holds.

    ``vectors`` has vec_id and embedding, an array of any numbers.  Returns query_id, rank
    (from 1), vec_id and score, nearest first, ties to the smaller vec_id; all candidates if
    there are fewer.  Vectors that are null, empty, zero or hold null or non-finite
    components take no part; neither do rows without vec_id.  Where lengths differ, shorter
    vectors count as padded with zeros.  Of several such rows with one vec_id, the one with
    the smallest vector counts.  ``centroids`` per half grow with the number of entries, up
    to 256.
    """
    kind = "float" if "float" in vectors.schema["embedding"].dataType.simpleString() else "double"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"), is_query.alias("is_query")).filter("vec_id is not null").filter(usable(F.col("embedding")))
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    longest = rows.agg(F.max(F.size("embedding")), F.min(F.size("embedding"))).first()
    if longest[0] is None:
        return spark.createDataFrame([], schema)
    dims = max(2, longest[0])
    if longest[1] < dims:
        rows = rows.withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0).cast(kind), F.lit(dims) - F.size("embedding"))))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("is_query").alias("is_query"))
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = checkpoint(rows.withColumn("n", rank).filter(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    sample = np.array([r["embedding"] for r in entries.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(SAMPLE).collect()], np.float64)
    size = centroids or int(np.clip(round((n / PER_CELL) ** 0.5), 2, 256))
    books = tuple(k_means(h, size, seed=11 + i) for i, h in enumerate(halves(sample)))
    share = share_needed(sample, books, k, recall)
    held, width = spark.sparkContext.broadcast(books), len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(cells_of(matrix(batch.column("embedding"), dims), held.value)), batch.column("embedding"), batch.column("ids")], ["cell", "embedding", "ids"])

    placed = checkpoint(entries.mapInArrow(assign, f"cell long, embedding array<{kind}>, ids array<long>"))
    counts = np.zeros(len(books[0]) * width, np.int64)  # 65,536 at most
    ids_of_shelf = np.zeros(len(books[0]), np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("n_ids")).collect():
        counts[r["cell"]] = r["n"]
        ids_of_shelf[r["cell"] // width] += r["n_ids"]
    blocks_of = np.maximum(1, -(-ids_of_shelf // BLOCK))
    enough = max(k + 1, int(np.ceil(share * n)))
    counted = spark.sparkContext.broadcast(counts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shelf that queries of the batch visit, with their ids, vectors and cells packed."""
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x, ids = matrix(batch.column("embedding"), dims), batch.column("vec_id").to_numpy()
                left, right = (distances(h, c) for h, c in zip(halves(x), held.value, strict=True))
                visited = np.zeros((len(x), len(counts)), bool)
                for i in range(len(x)):
                    visited[i, walk(left[i], right[i], counted.value, enough)] = True
                visited = visited.reshape(len(x), -1, width)
                rows = []
                for shelf in np.flatnonzero(visited.any(axis=(0, 2))).tolist():
                    mine = np.flatnonzero(visited[:, shelf].any(axis=1))
                    rows.append((shelf, ids[mine].tobytes(), x[mine].tobytes(), np.packbits(visited[mine, shelf], axis=1).tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shelf", "query_ids", "query_vectors", "query_cells"])

    number = F.element_at(F.array(*[F.lit(int(b)) for b in blocks_of]), (F.col("shelf") + 1).cast("int"))
    visits = rows.filter("is_query").select("vec_id", "embedding").mapInArrow(route, "shelf long, query_ids binary, query_vectors binary, query_cells binary")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), number - 1)))
    dealt = placed.withColumn("shelf", F.floor(F.col("cell") / width)).withColumn("block", F.pmod(F.xxhash64("embedding"), number).cast("int"))
    blocks = dealt.groupBy("shelf", "block").agg(F.collect_list((F.col("cell") % width).cast("int")).alias("cells"), F.collect_list("embedding").alias("embeddings"), F.collect_list("ids").alias("ids"))
    met = visits.join(blocks, ["shelf", "block"]).select("query_ids", "query_vectors", "query_cells", "cells", "embeddings", "ids")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for row in range(batch.num_rows):
                queries = np.frombuffer(batch.column("query_ids")[row].as_py(), np.int64)
                q = np.frombuffer(batch.column("query_vectors")[row].as_py(), np.float64).reshape(-1, dims)
                cells = np.unpackbits(np.frombuffer(batch.column("query_cells")[row].as_py(), np.uint8).reshape(len(q), -1), axis=1, count=width).astype(bool)
                v = matrix(batch.column("embeddings")[row].values, dims)
                members = batch.column("ids")[row].values
                ids, entry = np.asarray(members.flatten()), np.repeat(np.arange(len(v)), np.asarray(members.value_lengths()))
                scores = np.where(cells[:, np.asarray(batch.column("cells")[row].values)], q @ v.T, -np.inf)[:, entry]
                scores[queries[:, None] == ids] = -np.inf
                best.meet(queries, scores, ids)
            if len(best.place) > HELD:
                yield best.rows()
                best = Best(k)
        yield best.rows()

    found = met.mapInArrow(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
