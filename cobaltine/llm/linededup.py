"""Line dedup: document counts of distinct lines in a sharded minimal perfect hash.

1.  Every document's distinct line keys are hashed (two independent 64-bit hashes) and
    counted per slice of the input, then summed in Spark.
2.  The keys that reach ``min_docs`` are dealt to shards by hash.  Each shard becomes a
    minimal perfect hash (levels of bit arrays; a key's slot is the rank of its bit) over
    two parallel arrays: a 64-bit fingerprint and the document count.
3.  Documents are read again and probe the arrays; lines are not joined with one another.

The arrays hold only keys that reach ``min_docs``.  Up to ``broadcast_bytes`` they are
broadcast whole.  Beyond that, the hashes of all lines are dealt to their shards once and
probed there, a shard with many lines in several parts; the keys found meet the texts in a
join that Spark can split where a third of all rows are copies of one text, and which shuffles the
texts once.  Every row is a document of its own, whatever its doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SPACE, mix, slices, span_hashes, text_bytes
from .storage import anew, checkpoint

#: bits of a level's array for each key that is still without a slot
SPREAD = 2


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (split at \\n), and the index of each row's first line (one more at the end)."""
    breaks = np.flatnonzero(data == 10)
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    inner = np.ones(len(start), bool)
    inner[first[:-1]] = False
    start[first[:-1]], start[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    end[first[1:] - 1], end[inner] = offsets[1:], breaks
    return start, end, first


def line_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each line's key (white space stripped, A-Z lower-cased), and whether the key is long enough."""
    s, e = start.copy(), end.copy()
    for edge, step, at in ((s, 1, 0), (e, -1, -1)):
        todo = np.flatnonzero(s < e)
        while len(todo := todo[SPACE[data[edge[todo] + at]]]):
            edge[todo] += step
            todo = todo[s[todo] < e[todo]]
    long_enough = e - s >= min_chars
    if min_chars > 1:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long_enough = points[e] - points[s] >= min_chars
    lowered = LOWER[data]
    return span_hashes(lowered, s, e, 0), span_hashes(lowered, s, e, 1), long_enough


def count_keys(documents: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(h1, h2, docs) of each key in at least ``min_docs`` documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            data, offsets = text_bytes(batch.column("text"))
            start, end, first = line_spans(data, offsets)
            h1, h2, ok = line_keys(data, start, end, min_chars)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[ok]
            h1, h2 = h1[ok], h2[ok]
            order = np.lexsort((row, h2, h1))
            h1, h2, row = h1[order], h2[order], row[order]
            new_key = np.ones(len(h1), bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new = new_key.copy()
            new[1:] |= row[1:] != row[:-1]
            docs = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key)) if len(h1) else np.zeros(0, np.int64)
            yield pa.record_batch([h1[new_key].view(np.int64), h2[new_key].view(np.int64), docs], ["h1", "h2", "docs"])

    parts = documents.select("text").mapInArrow(count, "h1 long, h2 long, docs long")
    return parts.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)


class Shard:
    """A minimal perfect hash with its fingerprint and count arrays."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts = sizes, bits, prints, counts
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> Shard:
        """Keys, distinct pairs of hashes, that are alone at their bit of a level settle there; the rest go on to the next level."""
        sizes, levels, left = [], [], np.arange(len(h1))
        while len(left):
            size = 64 * -(-SPREAD * len(left) // 64)
            at = cls.position(h1[left], h2[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        shard = cls(np.array(sizes, np.int64), np.concatenate([*levels, np.zeros(0, np.uint64)]), np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.int64))
        slot = shard.slots(h1, h2)
        shard.prints[slot], shard.counts[slot] = h1 ^ h2, counts
        return shard

    @staticmethod
    def position(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        """Both hashes count, so that keys which share one of them part at some level."""
        first = mix(h1 + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        return (mix(first + h2) % np.uint64(size)).astype(np.int64)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key; -1, or the slot of another key, for those that the shard was not built from."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist(), strict=False)):
            at = start + self.position(h1[left], h2[left], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = (self.ranks[at >> 6] + below)[found]
            left = left[~found]
        return out

    def docs(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Document count of each key, 0 where the fingerprint says that it is not among the shard's keys."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64)
        slot = self.slots(h1, h2)
        return np.where((slot >= 0) & (self.prints[slot] == h1 ^ h2), self.counts[slot], 0)


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """One row for each shard; hashes deal the keys out evenly, so that a shard's size is bounded."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = Shard.build(pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64), pdf["docs"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], **{k: [getattr(x, k).tobytes()] for k in ("sizes", "bits", "prints", "counts")}})

    number = F.pmod(F.shiftrightunsigned("h1", 32), F.lit(shards)).cast("int")
    return keys.withColumn("shard", number).groupBy("shard").applyInPandas(build, "shard int, sizes binary, bits binary, prints binary, counts binary")


def load(row) -> Shard:
    return Shard(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint64), np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.int64))


def probe(held: dict[int, Shard], shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out, shard = np.zeros(len(h1), np.int64), shard_of(h1, shards)
    for k in np.unique(shard).tolist():
        if k in held:
            rows = np.flatnonzero(shard == k)
            out[rows] = held[k].docs(h1[rows], h2[rows])
    return out


def dedup_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_keys: int = 50_000, broadcast_bytes: int = 64 << 20, part_lines: int = 1_000_000, with_columns: tuple[str, ...] = ()) -> DataFrame:
    """Drops the lines whose key occurs in at least ``min_docs`` rows, from every row.

    ``documents`` has doc_id and text; each row is a document.  Returns for each row: doc_id,
    n_lines (before dropping), n_dropped, kept_sha256 and kept (the text that is left; null
    if the text was).  A null or empty text is one empty line.  Lines whose key has fewer
    than ``min_chars`` code points stay.  ``with_columns`` names further columns
    to carry along.  No row is lost; rows with the same doc_id, or with none, are separate
    documents, and a repeated row counts each time.
    """
    documents = documents.select("doc_id", "text", *with_columns)
    schema = ", ".join([DROPPED, *(f"{c} {documents.schema[c].dataType.simpleString()}" for c in with_columns)])
    keys = checkpoint(count_keys(documents, min_docs, min_chars))
    n_keys = keys.count()
    shards = max(1, -(-n_keys // shard_keys))
    built = build_shards(keys, shards)
    if 20 * n_keys <= broadcast_bytes:
        arrays = documents.sparkSession.sparkContext.broadcast({r["shard"]: load(r) for r in built.collect()})
        return documents.mapInArrow(lambda batches: drop_lines(batches, lambda h1, h2, _: probe(arrays.value, shards, h1, h2) > 0, min_chars, with_columns), schema)
    # equal texts share their lines' fate, so a hash of the text names what is found; should two texts share it, each still looks for its own lines only
    named = documents.withColumn("place", F.xxhash64(F.coalesce("text", F.lit(""))))
    per_text = probed(named.select("place", "text"), checkpoint(built), shards, min_chars, part_lines).groupBy("place").agg(F.collect_set(F.struct("h1", "h2")).alias("found"))
    joined = named.join(anew(per_text, "place"), "place", "left").select("doc_id", "text", *with_columns, "found")
    return joined.mapInArrow(lambda batches: drop_lines(batches, among, min_chars, with_columns), schema)


DROPPED = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"


def probed(named: DataFrame, built: DataFrame, shards: int, min_chars: int, part_lines: int) -> DataFrame:
    """(place, h1, h2) of the lines of (place, text) whose key one of the shards holds."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            start, end, first = line_spans(data, offsets)
            h1, h2, ok = line_keys(data, start, end, min_chars)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))[ok]
            h1, h2 = h1[ok], h2[ok]
            yield pa.record_batch([pa.array(shard_of(h1, shards).astype(np.int32)), batch.column("place").take(pa.array(row)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["shard", "place", "h1", "h2"])

    def look(lines: pa.Table, arrays: pa.Table) -> pa.Table:
        if not arrays.num_rows:
            return lines.select(["place", "h1", "h2"]).slice(0, 0)
        shard = load({c: arrays.column(c)[0].as_py() for c in ("sizes", "bits", "prints", "counts")})
        h1, h2 = (lines.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        return lines.select(["place", "h1", "h2"]).filter(pa.array(shard.docs(h1, h2) > 0))

    lines = named.mapInArrow(deal, "shard int, place long, h1 long, h2 long")
    # a line that a third of all texts hold makes its shard large, so a shard is as many parts as its lines need
    parts = F.ceil(F.col("lines") / part_lines).cast("int")
    sizes = checkpoint(lines.groupBy("shard").agg(F.count("*").alias("lines")).select("shard", parts.alias("parts")))
    many = sizes.filter("parts > 1").toArrow()  # a row a shard of 50,000 keys at most
    by_shard = dict(zip(many.column("shard").to_pylist(), many.column("parts").to_pylist(), strict=True))
    held = named.sparkSession.sparkContext.broadcast(np.array([by_shard.get(i, 1) for i in range(shards)], np.int64))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = held.value[batch.column("shard").to_numpy()]
            deal_by = mix(batch.column("place").to_numpy().view(np.uint64).copy()) % of.astype(np.uint64)
            yield pa.record_batch([*batch.columns, pa.array(deal_by.astype(np.int32))], [*batch.schema.names, "part"])

    lines = lines.mapInArrow(part, "shard int, place long, h1 long, h2 long, part int")
    copies = built.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return lines.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(look, "place long, h1 long, h2 long")


def among(h1: np.ndarray, h2: np.ndarray, found: pa.StructArray) -> np.ndarray:
    """Which of some lines are among those found for their text."""
    known = set(zip(found.field("h1").to_numpy().view(np.uint64).tolist(), found.field("h2").to_numpy().view(np.uint64).tolist(), strict=True))
    return np.array([x in known for x in zip(h1.tolist(), h2.tolist(), strict=True)], bool)


def drop_lines(batches: Iterator[pa.RecordBatch], is_common, min_chars: int, with_columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """``is_common`` takes the hashes of some lines and what the batch's rows found, if the batch has that column."""
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        start, end, first = line_spans(data, offsets)
        h1, h2, ok = line_keys(data, start, end, min_chars)
        if "found" in batch.schema.names:
            drop = np.zeros(len(h1), bool)
            for i, x in enumerate(batch.column("found")):
                if x.is_valid:
                    rows = slice(first[i], first[i + 1])
                    drop[rows] = ok[rows] & is_common(h1[rows], h2[rows], x.values)
        else:
            drop = ok & is_common(h1, h2, None)
        dropped = np.concatenate([[0], np.cumsum(drop)])
        n_dropped = dropped[first[1:]] - dropped[first[:-1]]
        whole, kept = data.tobytes(), []
        for i, n in enumerate(n_dropped.tolist()):
            if n:
                stay = first[i] + np.flatnonzero(~drop[first[i] : first[i + 1]])
                kept.append(b"\n".join([whole[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]))
            else:
                kept.append(whole[offsets[i] : offsets[i + 1]])
        digests = [hashlib.sha256(x).hexdigest() for x in kept]
        texts = [x.decode("utf-8", "replace") if known else None for x, known in zip(kept, batch.column("text").is_valid().to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(n_dropped), pa.array(digests), pa.array(texts, pa.string()), *map(batch.column, with_columns)], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept", *with_columns])


def without_common_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``documents`` with the lines of ``dedup_lines`` dropped from text, and n_chars counted again; lang and source stay.

    No row is lost, whatever is null in it.  A null text stays null, with null n_chars; a text
    all of whose lines go becomes empty.  Rows with the same doc_id, or with none, are
    separate documents; a repeated row is two documents.
    """
    out = dedup_lines(documents, min_docs, min_chars, with_columns=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))
