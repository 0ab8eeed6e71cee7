"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity, so comparing signatures
of both sides would miss it.  Containment is estimated from the item's side instead: items
are partitioned by size, each gets the smallest hashes of its shingles (a bottom-k MinHash
sketch, k set by its partition), and a document is a candidate if its shingles hold any of
them.  With k above the share of shingles that may be missing, every document that holds
enough of an item also holds one of its minima, so no candidate is lost.  Candidates are
then confirmed by exact containment of the shingles themselves.

Items are broadcast in blocks of about ``block_shingles`` shingles and ``block_bytes`` bytes;
a larger benchmark means more passes over the documents.  A document meets all items of a
block where it is read, so nothing but the pairs found is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, rolled, slices, span_hashes, text_bytes, words
from .storage import broadcast_if_small, checkpoint


def shingled(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of words, the shingle hashes by their first word, and each row's first word."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    s, e, first = words(data, offsets)
    return data, s, e, rolled(span_hashes(data, s, e), size), first


def shingle_text(whole: bytes, s: np.ndarray, e: np.ndarray, at: int, size: int) -> bytes:
    return b" ".join([whole[a:b] for a, b in zip(s[at : at + size].tolist(), e[at : at + size].tolist(), strict=True)])


def sketch_size(n: int, percent: int) -> int:
    """Minima for items of n shingles: enough for all of the item's size partition (sizes up to the next power of two)."""
    most = 1 << max(0, n - 1).bit_length()
    return min(n, most - -(-percent * most // 100) + 1)


def item_shingles(benchmark: DataFrame, size: int, percent: int) -> DataFrame:
    """(entry, item_id, shingle, hash, minimum, n_shingles): the distinct shingles of each entry, which is one text of one item."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            data, s, e, hashes, first = shingled(batch.column("text"), size)
            whole, rows = data.tobytes(), []
            for item, a, b in zip(batch.column("item_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                h, at = np.unique(hashes[a : max(a, b - size + 1)], return_index=True)
                least = sketch_size(len(h), percent)
                entry += 1
                rows += [(entry, item, shingle_text(whole, s, e, a + i, size), x, rank < least, len(h)) for rank, (x, i) in enumerate(zip(h.view(np.int64).tolist(), at.tolist(), strict=True))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["entry", "item_id", "shingle", "hash", "minimum", "n_shingles"])

    # one row a text of an item, so that its shingles are counted and its minima taken together
    texts = benchmark.filter("item_id is not null").select("item_id", "text").distinct()
    return texts.mapInArrow(sketch, "entry long, item_id long, shingle binary, hash long, minimum boolean, n_shingles long")


@dataclass
class Sketches:
    """The shingles of some items, ordered by hash; entries with one hash follow one another."""

    #: distinct hashes, where their entries start (one more at the end), and whether any is a minimum
    hashes: np.ndarray
    starts: np.ndarray
    minimum: np.ndarray
    #: of each entry: its item, whether it is one of the item's minima, and its words
    item: np.ndarray
    is_minimum: np.ndarray
    words: list[bytes]
    #: of each entry of the benchmark, a text of an item: item_id and number of shingles
    ids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, block: DataFrame) -> Sketches:
        """Collects the shingles of a block of bounded size as Arrow columns."""
        t = block.select("entry", "item_id", "shingle", "hash", "minimum", "n_shingles").toArrow()
        entries, ids, n, h = (t.column(c).to_numpy() for c in ("entry", "item_id", "n_shingles", "hash"))
        _, first, item = np.unique(entries, return_index=True, return_inverse=True)
        order = np.argsort(h, kind="stable")
        hashes, starts = np.unique(h[order], return_index=True)
        minimum = t.column("minimum").to_numpy()[order]
        any_minimum = np.logical_or.reduceat(minimum, starts) if len(starts) else minimum
        return cls(hashes, np.append(starts, len(h)), any_minimum, item[order], minimum, t.column("shingle").take(pa.array(order)).to_pylist(), ids[first], n[first])


def search(batches: Iterator[pa.RecordBatch], sketches: Sketches, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, item_id, n_shingles, n_shared) of each row and item that it holds enough of.

    A row is a candidate for the items of which it has a minimum.  Candidates that share
    enough hashes are confirmed on the words themselves.
    """
    k = sketches
    tags = np.zeros(1 << 22, bool)  # a first look by some bits of the hash
    tags[k.hashes & (1 << 22) - 1] = True
    spans = np.diff(k.starts)
    for batch in slices(batches, "text"):
        data, s, e, hashes, first = shingled(batch.column("text"), size)
        h = hashes.view(np.int64)
        at = np.flatnonzero(tags[h & (1 << 22) - 1])
        place = np.searchsorted(k.hashes, h[at])
        same = (place < len(k.hashes)) & (k.hashes[np.minimum(place, len(k.hashes) - 1)] == h[at]) if len(k.hashes) else np.zeros(len(at), bool)
        at, place = at[same], place[same]
        row = np.searchsorted(first, at, "right") - 1
        inside = at + size <= first[row + 1]
        at, place, row = at[inside], place[inside], row[inside]
        wanted = np.zeros(batch.num_rows, bool)
        wanted[row[k.minimum[place]]] = True
        at, place, row = at[wanted[row]], place[wanted[row]], row[wanted[row]]
        # each hash of a row once, then each entry that has it
        shared = np.unique(row * len(k.hashes) + place) if len(row) else row
        r, p = np.divmod(shared, max(1, len(k.hashes)))
        entry, ends = np.repeat(k.starts[p] - np.cumsum(spans[p]) + spans[p], spans[p]), np.repeat(r, spans[p])
        entry = entry + np.arange(len(entry))
        pair, which = np.unique(ends * len(k.ids) + k.item[entry], return_inverse=True)
        counts, minima = np.bincount(which, minlength=len(pair)), np.bincount(which, k.is_minimum[entry], len(pair)) > 0
        near = np.flatnonzero(minima & (counts * 100 >= percent * k.sizes[pair % max(1, len(k.ids))]))
        whole, texts, rows = data.tobytes(), {}, []
        bounds, order = np.searchsorted(row, np.arange(batch.num_rows + 1)), np.argsort(which, kind="stable")
        entries = np.split(entry[order], np.cumsum(counts)[:-1]) if len(pair) else []
        for i in near.tolist():
            r, item = divmod(int(pair[i]), len(k.ids))
            if r not in texts:
                texts = {r: {shingle_text(whole, s, e, x, size) for x in at[bounds[r] : bounds[r + 1]].tolist()}}
            n = sum(k.words[x] in texts[r] for x in entries[i].tolist())
            if 100 * n >= percent * int(k.sizes[item]):
                rows.append((r, int(k.ids[item]), int(k.sizes[item]), n))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.record_batch([batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "n_shingles", "n_shared"])


def contained_items(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, block_shingles: int = 500_000, block_bytes: int = 64 << 20) -> DataFrame:
    """Pairs of a document and a benchmark item of whose distinct shingles it holds ``percent`` % or more.

    ``documents`` has doc_id and text, ``benchmark`` item_id and text.  Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles ``size`` words.  Returns doc_id, item_id,
    n_shingles (of the item), n_shared and containment.  Items with fewer words, or a null
    or empty text, have no shingle and are found nowhere, and so has a document; rows without
    an id take no part.  Repeated rows give one pair.  Each of several texts with one item_id
    is searched on its own, in each of several texts with one doc_id: of the finds of a pair
    the one of the greatest containment counts, of these the one that shares most.  Other
    columns are not looked at.
    """
    documents = documents.select("doc_id", "text").filter("doc_id is not null")
    items = checkpoint(item_shingles(benchmark, size, percent))
    n, size_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.length("shingle") + 64), F.lit(0))).first()
    blocks = max(1, -(-n // block_shingles), -(-size_bytes // block_bytes))
    parts = []
    for i in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == i) if blocks > 1 else items
        held = documents.sparkSession.sparkContext.broadcast(Sketches.of(block))
        part = documents.mapInArrow(lambda batches, held=held: search(batches, held.value, size, percent), "doc_id long, item_id long, n_shingles long, n_shared long")
        if blocks > 1:  # pairs found are written before the next block is read, so that one block is held at a time
            part = checkpoint(part)
            held.destroy()
        parts.append(part)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shared", "n_shingles")).alias("best")
    pairs = functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment")


def without_items(documents: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no item.

    Rows without doc_id stay, as do null and empty texts.  Of rows with one doc_id all go if
    one holds an item.  With an empty benchmark all stay.
    """
    held = broadcast_if_small(contained_items(documents, benchmark, size, percent).select("doc_id").distinct())
    return documents.join(held, "doc_id", "left_anti").select(documents.columns)
