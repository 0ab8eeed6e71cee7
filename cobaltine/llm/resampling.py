"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A document's log weight is the sum, over its hashed word 1- and 2-grams, of the log ratio of
their probability in the target model and in the raw model.  Adding Gumbel noise, drawn from
the doc_id's hash, and taking the k largest keys samples k documents without replacement,
in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, rolled, slices, span_hashes, text_bytes, words
from .storage import checkpoint

BUCKETS = 10_000


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- and 2-grams of the rows, and their row."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    s, e, first = words(data, offsets)
    h = span_hashes(data, s, e)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    pairs = rolled(h, 2)
    within = row[: len(pairs)] == row[1:] if len(row) else np.zeros(0, bool)
    buckets = np.concatenate([h, pairs[within]]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([row, row[: len(pairs)][within]])


def gram_counts(documents: DataFrame) -> np.ndarray:
    """Counts of all buckets over all rows; each task hands on its sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(grams(batch.column("text"))[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in documents.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = target + smoothing, raw + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def log_weights(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bucket, row = grams(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.bincount(row, held.value[bucket], batch.num_rows).astype(np.float64))], ["doc_id", "log_weight"])

    return documents.select("doc_id", "text").mapInArrow(weigh, "doc_id long, log_weight double")


def cut(rows: DataFrame, k: int, bins: int = 4096) -> tuple[float, int] | None:
    """Key and doc_id of the k-th row by key (falling), then doc_id; found by counting rows in ever narrower bins."""
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    while True:
        part = rows.filter(F.col("key").between(low, high))
        if high <= low:
            break
        width = (high - low) / bins
        number = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        counts = {r["bin"]: r for r in part.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b]["n"]:
                break
            k -= counts[b]["n"]
        low, high, n = counts[b]["low"], counts[b]["high"], counts[b]["n"]
        part = rows.filter(F.col("key").between(low, high))
        if n <= bins:
            break
    last = part.orderBy(F.desc("key"), "doc_id").limit(k).agg(F.min("key").alias("key"), F.max_by("doc_id", F.struct(-F.col("key"), "doc_id")).alias("doc_id")).first()
    return last["key"], last["doc_id"]


def resample(documents: DataFrame, target_ids: DataFrame, share: float, seed: int = 0, target_rows: int = 20_000) -> DataFrame:
    """Samples round(share * rows) documents that look like the target ones.

    ``documents`` has doc_id and text, ``target_ids`` the doc_id of target rows, of which at
    most ``target_rows``, by hash, train the target model; the raw model counts every row.
    Returns for each row: doc_id, log_weight, key and selected.  A null or empty text has log
    weight 0, as has every text if there is no target row.  Of equal keys the smaller doc_id
    is taken first; rows with the same doc_id and text are taken together.  Rows without
    doc_id are left out.
    """
    documents = documents.select("doc_id", "text").filter("doc_id is not null")
    ids = target_ids.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(target_rows)
    target = gram_counts(documents.join(F.broadcast(ids), "doc_id", "left_semi"))  # target_rows ids at most
    ratios = log_ratios(target, gram_counts(documents)) if target.any() else np.zeros(BUCKETS)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id"), 11) + 0.5) / float(1 << 53)
    scored = checkpoint(log_weights(documents, ratios).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    last = cut(scored, round(share * scored.count()))
    if last is None:
        return scored.withColumn("selected", F.lit(False))
    key, doc_id = last
    return scored.withColumn("selected", (F.col("key") > key) | (F.col("key") == key) & (F.col("doc_id") <= doc_id))
