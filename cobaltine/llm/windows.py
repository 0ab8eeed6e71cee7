"""Substring dedup: words covered by a window that also starts in an earlier document.

Windows of a fixed number of words get Rabin-Karp hashes from prefix sums.  Shuffling every
window would move several times the input, so windows are first taken together in runs: the
consecutive windows of a document that share the same smallest k-word hash, their anchor.
Equal windows have equal anchors, so it is enough to compare within an anchor:

1.  Every run is hashed whole.  A run that an earlier document has too is a hit: all its
    windows are repeated.
2.  Where an anchor has different runs, the windows of the runs that are no hit are compared
    one by one.  The earliest document with a window is never a hit in its run, so nothing
    is lost.
3.  Documents meet their hits and merge them into maximal intervals to be removed.

Each slice of the input keeps only its earliest document per run (later ones are hits at
once) and one marker per anchor with several runs.  A task remembers what several documents
of it shared, so a passage that a third of all documents share reaches the shuffle about
once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import MULTIPLIERS, mix, rolled, slices, span_hashes, text_bytes, words
from .storage import checkpoint

ANCHOR_WORDS = 5
#: kinds of rows: a run to be compared; one known to be a hit; one whose windows must be compared; marks that an anchor has several runs
RUN, HIT, OPEN, MARK = range(4)


class Windowed:
    """Words, windows and runs of a batch of texts."""

    def __init__(self, column: pa.Array, window: int):
        self.data, self.offsets = text_bytes(column)
        self.start, self.end, self.first = words(self.data, self.offsets)
        self.window = window
        h = span_hashes(self.data, self.start, self.end)
        counts = np.diff(self.first)
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(h))
        #: the first word of each window that lies within one text, and its row
        self.at = np.flatnonzero(at + window <= self.first[1:][row])
        self.row = row[self.at]
        q = [np.uint64(x) for x in MULTIPLIERS]
        self.sums = [self.prefix_sums(h, x) for x in q]
        self.q = q
        k = min(ANCHOR_WORDS, window)
        grams = rolled(h, k)
        if len(self.at):
            views = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
            place = np.empty(len(self.at), np.int64)
            for i in range(0, len(self.at), 1 << 16):
                part = self.at[i : i + (1 << 16)]
                place[i : i + (1 << 16)] = part + views[part].argmin(axis=1)
        else:
            place = np.zeros(0, np.int64)
        new = np.ones(len(self.at), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.row[1:] != self.row[:-1])
        self.run_of_window = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.run_windows = np.diff(np.append(heads, len(self.at)))
        self.run_row = self.row[heads]
        self.anchor = grams[place[heads]] if len(heads) else np.zeros(0, np.uint64)
        self.run = self.hashed(self.at[heads], self.run_windows + window - 1, 0)

    @staticmethod
    def prefix_sums(h: np.ndarray, q: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Sums of h[i] * q**i modulo 2**64, and the inverse powers that move a difference back to its start."""
        inverse = np.uint64(pow(int(q), -1, 1 << 64))
        powers = np.cumprod(np.full(len(h), q)) if len(h) else np.zeros(0, np.uint64)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)]), np.cumprod(np.full(len(h), inverse)) if len(h) else powers

    def hashed(self, at: np.ndarray, size, which: int) -> np.ndarray:
        """Rabin-Karp hash of ``size`` words from ``at`` on."""
        sums, back = self.sums[which]
        return mix((sums[at + size] - sums[at]) * back[at] + np.asarray(size).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def windows(self, which: int) -> np.ndarray:
        return self.hashed(self.at, self.window, which)


def spread(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A key that no group needs; rows with it only have to be dealt evenly."""
    return mix(x * np.uint64(MULTIPLIERS[1]) ^ doc.astype(np.uint64) ^ np.uint64(0xA5A5A5A5))


def starts_of(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Seen:
    """Pairs of hashes that a task has handed on already, with the smallest document of each.

    Only saves rows: it takes no more pairs when it is full, and what it does not know is
    handed on once more.
    """

    NONE = np.iinfo(np.int64).max

    def __init__(self, most: int = 1 << 18):
        self.most = most
        self.code, self.a, self.b, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.code):
            return np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        at = np.minimum(np.searchsorted(self.code, spread(a, b)), len(self.code) - 1)
        return at, (self.a[at] == a) & (self.b[at] == b)

    def earliest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at, known = self.places(a, b)
        return np.where(known, self.doc[at], self.NONE) if len(self.code) else np.full(len(a), self.NONE)

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> None:
        at, known = self.places(a, b)
        np.minimum.at(self.doc, at[known], doc[known])
        a, b, doc = (x[~known] for x in (a, b, doc))
        room = self.most - len(self.code)
        if len(a) and room > 0:
            code, first = np.unique(spread(a, b), return_index=True)
            new = first[~np.isin(code, self.code)][:room]
            columns = [np.concatenate([x, y[new]]) for x, y in ((self.code, spread(a, b)), (self.a, a), (self.b, b), (self.doc, doc))]
            order = np.argsort(columns[0])
            self.code, self.a, self.b, self.doc = (x[order] for x in columns)


def run_rows(batch: pa.RecordBatch, window: int, seen: Seen, marked: Seen) -> pa.RecordBatch:
    w = Windowed(batch.column("text"), window)
    anchor, run, doc = w.anchor, w.run, batch.column("doc_id").to_numpy()[w.run_row]
    order = np.lexsort((doc, run, anchor))
    anchor, run, doc = anchor[order], run[order], doc[order]
    order = np.flatnonzero(starts_of(anchor, run, doc))
    anchor, run, doc = anchor[order], run[order], doc[order]
    new_run, new_anchor = starts_of(anchor, run), starts_of(anchor)
    group = np.cumsum(new_anchor) - 1
    heads = np.flatnonzero(new_anchor)
    runs = np.add.reduceat(new_run.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
    lowest = np.minimum.reduceat(doc, heads) if len(heads) else doc
    highest = np.maximum.reduceat(doc, heads) if len(heads) else doc
    several = (runs > 1) & (lowest < highest)
    zeros = np.zeros(len(heads), np.uint64)
    old_marks = marked.earliest(anchor[heads], zeros) < Seen.NONE
    kind = np.where(new_run, np.where((several | old_marks)[group], OPEN, RUN), HIT).astype(np.int8)
    kind[doc > seen.earliest(anchor, run)] = HIT
    key = np.where(kind == RUN, anchor, spread(run, doc))
    shared = np.flatnonzero(new_run[:-1] & ~new_run[1:])  # the first document of a run that others follow
    seen.add(anchor[shared], run[shared], doc[shared])
    several &= ~old_marks
    marks = heads[several]
    marked.add(anchor[marks], zeros[several], doc[marks])
    return pa.record_batch(
        [np.concatenate([key, anchor[marks]]).view(np.int64), np.concatenate([run, run[marks]]).view(np.int64), np.concatenate([doc, lowest[several]]), np.concatenate([kind, np.full(len(marks), MARK, np.int8)])],
        ["key", "run", "doc_id", "kind"],
    )


def window_rows(batch: pa.RecordBatch, window: int, seen: Seen) -> pa.RecordBatch:
    """Windows of the open runs; of equal ones in this batch, all but the earliest document's are hits at once."""
    w = Windowed(batch.column("text"), window)
    is_open = np.zeros(len(w.run), bool)
    bounds = np.searchsorted(w.run_row, np.arange(batch.num_rows + 1))
    for i, x in enumerate(batch.column("open")):
        is_open[bounds[i] : bounds[i + 1]] = np.isin(w.run[bounds[i] : bounds[i + 1]], longs(x))
    rows = np.flatnonzero(is_open[w.run_of_window]) if len(w.run) else np.zeros(0, np.int64)
    h1, h2, doc = w.windows(0)[rows], w.windows(1)[rows], batch.column("doc_id").to_numpy()[w.row[rows]]
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[order], h2[order], doc[order]
    order = np.flatnonzero(starts_of(h1, h2, doc))
    h1, h2, doc = h1[order], h2[order], doc[order]
    first = starts_of(h1, h2)
    shared = np.flatnonzero(first[:-1] & ~first[1:])
    first &= doc < seen.earliest(h1, h2)
    seen.add(h1[shared], h2[shared], doc[shared])
    key = np.where(first, h2, spread(h1, doc))
    return pa.record_batch([key.view(np.int64), h1.view(np.int64), doc, np.where(first, RUN, HIT).astype(np.int8)], ["key", "run", "doc_id", "kind"])


def all_run_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    seen, marked = Seen(), Seen()
    for batch in slices(batches, "text", 4 << 20):
        yield run_rows(batch, window, seen, marked)


def all_window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    seen = Seen()
    for batch in slices(batches, "text", 4 << 20):
        yield window_rows(batch, window, seen)


def longs(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy().view(np.uint64) if x.is_valid else np.zeros(0, np.uint64)


def removed_words(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        w = Windowed(batch.column("text"), window)
        h = w.windows(0)
        hit = np.zeros(len(w.at), bool)
        bounds = np.searchsorted(w.row, np.arange(batch.num_rows + 1))
        for i, (runs, single) in enumerate(zip(batch.column("hits"), batch.column("windows"), strict=True)):
            part = slice(bounds[i], bounds[i + 1])
            if runs.is_valid and len(runs):
                hit[part] = np.isin(w.run[w.run_of_window[part]], longs(runs))
            if single.is_valid and len(single):
                hit[part] |= np.isin(h[part], longs(single))
        edges = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(edges, w.at[hit], 1)
        np.add.at(edges, w.at[hit] + window, -1)
        removed = np.cumsum(edges)[:-1] > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[w.first])
        whole, texts = w.data.tobytes(), []
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            stay = a + np.flatnonzero(~removed[a:b])
            # an interval of kept words whose gaps are single blanks is one piece of the text
            texts.append(b" ".join([whole[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]) if n_removed[i] else b" ".join(whole[w.offsets[i] : w.offsets[i + 1]].split()))
        digests = [hashlib.sha256(x).hexdigest() for x in texts]
        kept = pa.array([x.decode("utf-8", "replace") if known else None for x, known in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True)], pa.string())
        yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(w.first)), pa.array(n_removed), pa.array(digests), kept], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


ROWS = "key long, run long, doc_id long, kind byte"


def dedup_windows(documents: DataFrame, window: int = 13) -> DataFrame:
    """Removes each word that lies in a window of ``window`` words which also starts in a row with a smaller doc_id.

    ``documents`` has doc_id and text.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Windows are
    judged on the input, not on what is left.  Returns for each row: doc_id, n_words,
    n_removed, kept_sha256 and kept (the other words joined by blanks; null if the text was).
    A null or empty text has no words.  A text with fewer words than a window keeps them
    all.  Rows without doc_id are left out; rows with the same doc_id never remove each
    other's words, and a repeated row gives a repeated row.  Other columns are not looked at.
    """
    documents = documents.select("doc_id", "text").filter("doc_id is not null")
    rows = documents.mapInArrow(lambda batches: all_run_rows(batches, window), ROWS)
    by_key, by_run = Window.partitionBy("key"), Window.partitionBy("key", "run")
    compared = F.col("kind").isin(RUN, MARK)
    several = (F.max(F.when(F.col("kind") == MARK, True)).over(by_key)) | (F.min(F.when(compared, F.col("run"))).over(by_key) < F.max(F.when(compared, F.col("run"))).over(by_key)) & (F.min("doc_id").over(by_key) < F.max("doc_id").over(by_key))
    # one of RUN, HIT, OPEN remains for each row
    judged = rows.withColumns({"several": F.coalesce(several, F.lit(False)), "earliest": F.min(F.when(F.col("kind") == RUN, F.col("doc_id"))).over(by_run)})
    state = F.when((F.col("kind") == HIT) | (F.col("kind") == RUN) & (F.col("doc_id") > F.col("earliest")), HIT).when((F.col("kind") == OPEN) | (F.col("kind") == RUN) & F.col("several"), OPEN)
    found = judged.select("doc_id", "run", state.alias("state")).filter("state is not null")
    of = lambda kind, name: F.collect_list(F.when(F.col("state") == kind, F.col("run"))).alias(name)
    runs = checkpoint(found.groupBy("doc_id").agg(of(HIT, "hits"), of(OPEN, "open")))

    with_runs = documents.join(runs, "doc_id", "left")
    opened = with_runs.filter(F.size("open") > 0).select("doc_id", "text", "open")
    rows = opened.mapInArrow(lambda batches: all_window_rows(batches, window), ROWS)
    earliest = F.min(F.when(F.col("kind") == RUN, F.col("doc_id"))).over(by_run)
    single = rows.withColumn("earliest", earliest).filter((F.col("kind") == HIT) | (F.col("doc_id") > F.col("earliest")))
    windows = single.groupBy("doc_id").agg(F.collect_set("run").alias("windows"))
    ready = with_runs.join(windows, "doc_id", "left").select("doc_id", "text", "hits", "windows")
    return ready.mapInArrow(lambda batches: removed_words(batches, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
