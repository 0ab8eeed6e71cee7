"""Near duplicates: HyperMinHash bands propose pairs, full shingle sets confirm them.

1.  One pass over the texts gives each document's set size, a 128-bit digest of its set and
    its compressed registers.  Equal digests form a class; only its smallest doc_id goes on,
    so that exact copies never meet in a bucket.
2.  The registers are cut into bands.  In each bucket, the smallest member is paired with
    the others: a bucket costs as many pairs as it has members.
3.  Pairs whose sizes rule a link out are dropped, and those whose collision-corrected
    estimate is so low that a link has it with a chance of 1e-8 at most.  The rest is confirmed on
    full sets.
4.  Buckets whose members the confirmed links do not yet connect are compared in blocks
    inside tasks, members of different groups only.  Where the estimate allows a link, the
    one document is confirmed against every member of the other's group, again in blocks, a
    bounded number of them in a task: sets move once for GRID blocks of the other side, not
    once for each pair.  So every pair that shares a bucket
    is either connected or was compared, and no bucket is capped.
5.  Components of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, shingle_sets, slices, text_bytes
from .components import components
from .hyperminhash import REGISTERS, band_keys, estimate, least_estimate, registers
from .storage import MOST_BROADCAST, anew, broadcast_if_small, checkpoint

#: members of a bucket that are compared at once, bytes of sets that a block has on average at most, and blocks of either side that one task compares
BLOCK, BLOCK_BYTES, GRID = 128, 8 << 20, 16


def sets_of(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    return list(shingle_sets(LOWER[data], offsets, size))


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, other, registers) of each row, the digest as two numbers; the digest of an empty set is that of its doc_id, so that no group is made of them."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = sets_of(batch, size)
            regs = registers(sets)
            digests = b"".join([hashlib.blake2b(s.tobytes() or str(i).encode(), digest_size=16).digest() for s, i in zip(sets, batch.column("doc_id").to_pylist(), strict=True)])
            halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n_shingles", "digest", "other", "registers"])

    return documents.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, digest long, other long, registers binary")


def binary_rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def banded(reps: DataFrame) -> DataFrame:
    """(key, rep): a row for each band of each representative."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(binary_rows(batch.column("registers"), "<u2", REGISTERS))
            ids = np.repeat(batch.column("rep").to_numpy(), keys.shape[1])
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "rep"])

    return reps.select("rep", "registers").mapInArrow(bands, "key long, rep long")


def likely(n_a, n_b, percent: int):
    """Whether the sizes allow the similarity."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers allow the similarity."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(likely(F.col("n_a"), F.col("n_b"), percent))
    low = least_estimate(percent / 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = estimate(binary_rows(batch.column("r_a"), "<u2", REGISTERS), binary_rows(batch.column("r_b"), "<u2", REGISTERS)) >= low
            yield batch.select(["a", "b"]).filter(pa.array(close))

    return both.select("a", "b", "r_a", "r_b").mapInArrow(compare, "a long, b long")


def shingle_table(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): sorted hashes of the documents whose doc_id is wanted.

    Up to MOST_BROADCAST wanted ids go to the texts; beyond it the texts are shuffled to them.
    """
    wanted = broadcast_if_small(wanted, MOST_BROADCAST)

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array([s.tobytes() for s in sets_of(batch, size)], pa.binary())], ["doc_id", "shingles"])

    return documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(to_sets, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity.  Only texts that stand in a pair are read into sets."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))

    sets = shingle_table(documents, ends.select("doc_id").distinct(), size)
    of = lambda c: F.max(F.when(F.col("doc_id") == F.col(c), F.col("shingles"))).alias(f"s_{c}")
    both = ends.join(sets, "doc_id").groupBy("a", "b").agg(of("a"), of("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                same.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


def unconnected(shared: DataFrame, reps: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(rep, n_shingles, label): a document and a smaller label that a member of its buckets has, if the estimate allows a link.

    Buckets of three or more members with different labels are compared in blocks; those of
    the label that most members have are not compared with one another.  A bucket's smallest
    member has met all others before, and a pair is looked at in the first bucket it shares.
    """
    labelled = shared.filter("members > 2 and rep <> a").select("key", "rep").join(labels, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    per_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = per_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others"), F.count("*").alias("n_labels")).filter("n_labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", F.col("main.label").alias("main"), blocks(F.col("main.n")).alias("main_blocks"), blocks(F.col("others")).alias("other_blocks"))
    rows = labelled.join(anew(mixed, "key"), "key").join(reps.select("rep", "n_shingles", "registers"), "rep")
    is_main, deal = F.col("label") == F.col("main"), F.xxhash64("rep")
    block = F.when(is_main, F.pmod(deal, "main_blocks")).otherwise(F.col("main_blocks") + F.pmod(deal, "other_blocks")).cast("int")
    # blocks of the bucket's largest label meet the others, not one another
    other = F.explode(F.sequence(F.when(is_main, F.col("main_blocks")).otherwise(0), F.col("main_blocks") + F.col("other_blocks") - 1))
    dealt = rows.withColumn("block", block).withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    groups = dealt.groupBy("key", "i", "j").agg(F.collect_list("rep").alias("reps"), F.collect_list("label").alias("labels"), F.collect_list("block").alias("blocks"), F.collect_list("n_shingles").alias("sizes"), F.collect_list("registers").alias("registers"))
    low = least_estimate(percent / 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int, int]] = set()
            for row in range(batch.num_rows):
                ids, label, block, n, regs = (batch.column(c)[row].values for c in ("reps", "labels", "blocks", "sizes", "registers"))
                ids, label, block, n, regs = ids.to_numpy(), label.to_numpy(), block.to_numpy(), n.to_numpy(), binary_rows(regs, "<u2", REGISTERS)
                key, i, j = (batch.column(c)[row].as_py() for c in ("key", "i", "j"))
                bands = band_keys(regs).view(np.int64)
                at = int(np.argmax(bands[0] == key))
                for x in np.flatnonzero(block == i):
                    y = np.flatnonzero((block == j) & (label != label[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
                    y = y[~(bands[y, :at] == bands[x, :at]).any(axis=1)]
                    y = y[estimate(regs[y], regs[x][None]) >= low]
                    found.update((ids[x], n[x], o) for o in label[y][label[y] < label[x]].tolist())
                    up = y[label[y] > label[x]]
                    found.update((o, size, label[x]) for o, size in zip(ids[up].tolist(), n[up].tolist(), strict=True))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 3)
            yield pa.record_batch([pa.array(c) for c in pairs.T], ["rep", "n_shingles", "label"])

    return groups.mapInArrow(compare, "rep long, n_shingles long, label long").distinct()


def linked_to_groups(visits: DataFrame, reps: DataFrame, labels: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of each visit's document with a member of the group it visits; one link of each pair of them is enough."""
    labelled = reps.select("rep", "n_shingles").join(labels, "rep", "left").select("rep", "n_shingles", F.coalesce("label", "rep").alias("label"))
    members = labelled.join(visits.select("label").distinct(), "label", "left_semi").withColumn("visits", F.lit(False))
    visiting = visits.select("rep", "n_shingles", "label", F.lit(True).alias("visits"))
    wanted = members.unionByName(visiting)
    sets = shingle_table(documents, wanted.select(F.col("rep").alias("doc_id")).distinct(), size)
    rows = wanted.join(sets, wanted["rep"] == sets["doc_id"]).select("label", "visits", "rep", "shingles")
    blocks_of = lambda side: F.ceil(F.greatest(F.count_if(side) / BLOCK, F.sum(F.when(side, F.col("n_shingles") * 8).otherwise(0)) / BLOCK_BYTES)).cast("int")
    counted = wanted.groupBy("label").agg(blocks_of(F.col("visits")).alias("visit_blocks"), blocks_of(~F.col("visits")).alias("member_blocks"))
    dealt = rows.join(anew(counted, "label"), "label").withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("visits"), F.col("visit_blocks")).otherwise(F.col("member_blocks"))).cast("int"))
    blocks = checkpoint(dealt.groupBy("label", "visits", "block", "visit_blocks", "member_blocks").agg(F.collect_list("rep").alias("reps"), F.collect_list("shingles").alias("sets")))
    # GRID visiting blocks and GRID blocks of members meet in one task, so that no group is one task's
    cell = F.floor(F.col("block") / GRID).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / GRID).cast("int")))
    ours = blocks.filter("visits").select("label", cell.alias("i"), every("member_blocks").alias("j"), F.col("reps").alias("x"), F.col("sets").alias("x_sets"))
    theirs = blocks.filter("not visits").select("label", every("visit_blocks").alias("i"), cell.alias("j"), F.col("reps").alias("y"), F.col("sets").alias("y_sets"))
    met = ours.join(theirs, ["label", "i", "j"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in range(batch.num_rows):
                x, y = (batch.column(c)[row].as_py() for c in ("x", "y"))
                y_sets = [np.frombuffer(b, np.uint64) for b in batch.column("y_sets")[row].as_py()]
                flat, sizes = np.concatenate(y_sets), np.array(list(map(len, y_sets)), np.int64)
                starts = np.cumsum(sizes) - sizes
                for a, packed in zip(x, batch.column("x_sets")[row].as_py(), strict=True):
                    own = np.frombuffer(packed, np.uint64)
                    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    shared = np.add.reduceat((own[place] == flat).astype(np.int64), starts)
                    hit = np.flatnonzero(100 * shared >= percent * (sizes + len(own) - shared))
                    links += [(min(a, y[hit[0]]), max(a, y[hit[0]]))] if len(hit) else []
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return met.select("x", "x_sets", "y", "y_sets").mapInArrow(verify, "a long, b long")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Links documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    ``documents`` has doc_id and text.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.
    With fewer words, the whole sequence is the only shingle; a text that is null, empty or
    white space has none and is linked with nothing.  Returns for each row: doc_id,
    n_shingles, component_id (smallest doc_id reachable, itself included) and kept (whether
    the two are equal).  Rows without doc_id are left out; a repeated row gives a repeated
    row.  Other columns are not looked at.
    """
    documents = documents.select("doc_id", "text").filter("doc_id is not null")
    signed = checkpoint(signatures(documents, size))
    # a third of all rows may be copies of one text: minima are taken before the shuffle, and the join can be split
    classes = signed.groupBy("digest", "other").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    members = signed.select("doc_id", "n_shingles", "digest", "other").join(anew(classes, "digest"), ["digest", "other"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    reps = checkpoint(signed.filter("n_shingles > 0").groupBy("digest", "other", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("registers").alias("registers")).select("rep", "n_shingles", "registers"))

    bands = banded(reps)
    centres = bands.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("members")).filter("members > 1")
    shared = checkpoint(bands.join(anew(centres, "key"), "key"))  # most bands have one member and end here
    stars = shared.filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    tried = checkpoint(estimated(stars, reps, percent))
    links = checkpoint(confirmed(tried, documents, size, percent))

    labels = components(links).select(F.col("node").alias("rep"), F.col("root").alias("label"))
    visits = checkpoint(unconnected(shared, reps, labels, percent))
    more = linked_to_groups(visits, reps, labels, documents, size, percent)

    roots = components(labels.select(F.col("label").alias("a"), F.col("rep").alias("b")).unionByName(more))
    out = members.join(roots, members["rep"] == roots["node"], "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def without_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, all columns, that ``near_duplicates`` keeps.

    Of rows with the same doc_id and text one stays.  Of different texts with one doc_id all
    stay if one does.  Rows without doc_id cannot be told apart and all stay.  The ids of what
    goes are sent to the texts; only beyond MOST_BROADCAST of them do texts meet them in a
    shuffle.
    """
    named = documents.filter("doc_id is not null")
    repeated = broadcast_if_small(named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), MOST_BROADCAST)
    flags = near_duplicates(named, size, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = broadcast_if_small(flags.filter("not kept").select("doc_id"), MOST_BROADCAST)
    once = named.join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti")
    # only texts of repeated ids are dealt out anew
    more = named.join(repeated, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return once.select(documents.columns).unionByName(more.select(documents.columns)).unionByName(documents.filter("doc_id is null"))
