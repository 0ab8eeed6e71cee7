"""Centroid clustering in whole numbers: Lloyd's rounds that look only at what has changed.

The vectors are packed into blocks once and stay where they are.  Beside them there is a small
table of assignments (owner and distance of each vector), written to the checkpoint folder
each round, and on the driver the sums and counts of the centroids, whose size does not depend
on the data.  In a round, a vector whose owner stands still is compared with the centroids that
moved only; one whose owner moved is compared with all.  What changes its owner is taken
off one sum and put on another: blocks emit these signed transfers, and Spark adds them up.
All numbers are integers, so the result does not depend on any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import checkpoint

#: vectors of a block
BLOCK = 4096
#: components stay below this, so that squared distances of up to a thousand of them are exact in 64 bits
LARGEST = 1 << 26

ASSIGNED = "block long, owner binary, distance binary, transfers array<long>"


def usable(column: str, dimension: int) -> Column:
    """Whether a vector has ``dimension`` components, none of them null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(column) == dimension) & F.forall(column, finite), F.lit(False))


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x in double precision."""
    out = np.floor(scale * x)
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ArithmeticError(f"a component times {scale} is {LARGEST} or more: distances would not fit a long")
    return out.astype(np.int64)


def packed(vectors: DataFrame, scale: int, dimension: int) -> DataFrame:
    """(block, ids, points): up to BLOCK vectors (id, vector) a row, the points as 32-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                points = whole_numbers(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension), scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.record_batch([pa.array([block], pa.int64()), ids, pa.array([points.astype("<i4").tobytes()], pa.binary())], ["block", "ids", "points"])
                block += 1

    return vectors.mapInArrow(pack, "block long, ids array<long>, points binary")


def nearest(points: np.ndarray, centroids: np.ndarray, moved: np.ndarray, owner: np.ndarray | None, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Owner and squared distance of each point, given those of the round before; ties go to the smaller number."""
    if owner is None:
        owner, own = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        anew, moved = np.ones(len(points), bool), np.ones(len(centroids), bool)
    else:
        anew, owner, own = moved[owner], owner.copy(), own.copy()
        own[anew] = np.iinfo(np.int64).max
    for j in range(len(centroids)):
        # a centroid that stands still has been compared with all but the points that look anew
        rows = slice(None) if moved[j] else np.flatnonzero(anew)
        d = ((points[rows] - centroids[j]) ** 2).sum(axis=1)
        better = (d < own[rows]) | ((d == own[rows]) & (j < owner[rows]))
        owner[rows], own[rows] = np.where(better, j, owner[rows]), np.where(better, d, own[rows])
    return owner, own


def transfers(points: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> np.ndarray | None:
    """What changed owners adds to each centroid's sum and, as a last component, to its count; None if nothing changed."""
    rows = np.arange(len(after)) if before is None else np.flatnonzero(before != after)
    if not len(rows):
        return None
    out, ones = np.zeros((k, points.shape[1] + 1), np.int64), np.column_stack([points[rows], np.ones(len(rows), np.int64)])
    np.add.at(out, after[rows], ones)
    if before is not None:
        np.subtract.at(out, before[rows], ones)
    return out.ravel()


def assign(blocks: DataFrame, assigned: DataFrame | None, centroids: np.ndarray, moved: np.ndarray, dimension: int) -> DataFrame:
    """The next table of assignments.  Only the old one is shuffled, to where the blocks are."""
    rows = blocks.select("block", "points") if assigned is None else blocks.select("block", "points").join(assigned.select("block", "owner", "distance"), "block")
    k, begins = len(centroids), assigned is None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                points = np.frombuffer(batch.column("points")[row].as_buffer(), "<i4").reshape(-1, dimension).astype(np.int64)
                old = None if begins else np.frombuffer(batch.column("owner")[row].as_buffer(), "<i4").astype(np.int64)
                own = None if begins else np.frombuffer(batch.column("distance")[row].as_buffer(), "<i8")
                owner, own = nearest(points, centroids, moved, old, own)
                moves = transfers(points, old, owner, k)
                columns = [batch.column("block").slice(row, 1), pa.array([owner.astype("<i4").tobytes()], pa.binary()), pa.array([own.astype("<i8").tobytes()], pa.binary()), pa.array([moves], pa.list_(pa.int64()))]
                yield pa.record_batch(columns, ["block", "owner", "distance", "transfers"])

    return rows.mapInArrow(step, ASSIGNED)


def added_up(assigned: DataFrame, k: int, dimension: int) -> np.ndarray:
    """The sum of all transfers, as Python integers; k * (dimension + 1) numbers come to the driver."""
    each = assigned.select(F.posexplode("transfers").alias("place", "n")).groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = np.zeros(k * (dimension + 1), object)
    for place, n in each.collect():
        out[place] = int(n)
    return out.reshape(k, dimension + 1)


def delta_lloyd(vectors: DataFrame, order: Column, id_column: str = "vec_id", column: str = "embedding", k: int = 8, rounds: int = 10, scale: int = 1024, dimension: int = 64) -> DataFrame:
    """Clusters the vectors with exactly ``dimension`` components, none null or not finite; others take no part.

    Components become floor(``scale`` * x).  Centroids start as the ``k`` vectors that come
    first by ``order``, then by their components; rows for which it is null come last.  Each of
    ``rounds`` rounds assigns every vector to the nearest centroid (squared distance; ties: the smaller number) and
    replaces each centroid that has vectors by the floor of their mean; then vectors are
    assigned once more.  Rounds in which no centroid can move are left out.

    Returns for each vector: vec_id, cluster, distance (squared), cluster_inertia and inertia
    (distance summed over the cluster and over all) and centroid_sha256 (of the centroid's
    components in decimal, joined by commas).  Repeated rows and rows without an id are vectors
    like others.  Fewer vectors than ``k`` give fewer clusters, an empty table no row.  Components whose
    scaled value is 2**26 or more are an error, as distances would not fit a long.  Other columns are not looked at.
    """
    kept = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"), order.alias("place")).filter(usable("vector", dimension))
    seeds = [row[0] for row in kept.orderBy(F.asc_nulls_last("place"), "vector").limit(k).select("vector").collect()]
    if not seeds:
        return kept.selectExpr("id as vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    centroids = whole_numbers(np.array(seeds, float), scale)
    k = len(centroids)
    dealt = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = packed(kept.select("id", "vector"), scale, dimension).repartition(dealt, "block").sortWithinPartitions("block").persist()

    assigned, moved, totals = None, np.ones(k, bool), np.zeros((k, dimension + 1), object)
    for _ in range(rounds):
        assigned = checkpoint(assign(blocks, assigned, centroids, moved, dimension))
        totals = totals + added_up(assigned, k, dimension)
        after = np.array([[s // n for s in total] if n else old.tolist() for (*total, n), old in zip(totals.tolist(), centroids, strict=True)], np.int64)
        moved, centroids = (after != centroids).any(axis=1), after
        if not moved.any():
            break
    if assigned is None or moved.any():
        assigned = checkpoint(assign(blocks, assigned, centroids, moved, dimension))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                owner, own = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in (("owner", "<i4"), ("distance", "<i8")))
                yield pa.record_batch([batch.column("ids")[row].values, pa.array(owner, pa.int32()), pa.array(own, pa.int64())], ["vec_id", "cluster", "distance"])

    rows = checkpoint(blocks.select("block", "ids").join(assigned.select("block", "owner", "distance"), "block").mapInArrow(spread, "vec_id long, cluster int, distance long"))
    blocks.unpersist()
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(j, n, sum(inertia.values()), digests[j]) for j, n in inertia.items()]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
