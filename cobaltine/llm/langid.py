"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2- to 4-byte n-grams within words (with their boundaries) of the lower-cased
text, hashed into buckets.  A text is the average of its subwords' embeddings.  Embeddings
and softmax are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled rows whose features the executors compute.  Some of the sample's texts,
with their characters shuffled or replaced by random letters, stand for text of no language;
the softmax has a class for them.  A part of the sample is held back to fit a temperature and
the probability below which a prediction is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, slices, text_bytes

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
ORDERS = (2, 3, 4)
#: rows whose feature counts are held at once
ROWS = 256
UNKNOWN = "und"
#: one of so many sampled rows gives a text of no language, and the most characters of one
JUNK_EVERY, JUNK_CHARS = 4, 4000

LETTERS = np.zeros(256, bool)
LETTERS[[*range(97, 123), *range(128, 256)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-cases ASCII and Latin-1 letters; what is no letter becomes a blank."""
    low = LOWER[data]
    after = np.zeros(len(low), bool)
    after[1:] = low[:-1] == 0xC3
    low = np.where(after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + np.uint8(0x20), low)
    return np.where(LETTERS[low], low, np.uint8(32))


def feature_counts(column: pa.Array) -> np.ndarray:
    """float32 [rows, BUCKETS] of subword counts over whole texts."""
    data, offsets = text_bytes(column)
    b, n = folded(data).astype(np.uint32), len(column)
    blank = b == 32
    row = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * BUCKETS, np.int64)
    code, inner = b, np.ones(len(b), bool)
    for size in range(2, max(ORDERS) + 1):
        if len(b) < size:
            break
        code = code[:-1] | b[size - 1 :] << np.uint32(8 * (size - 1))
        inner = inner[:-1] & ~blank[size - 2 : -1] if size > 2 else inner[:-1]
        if size in ORDERS:
            good = inner & (row[: len(code)] == row[size - 1 :]) & ~(blank[: len(code)] & blank[size - 1 :])
            bucket = (code[good].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)) >> np.uint64(64 - BUCKET_BITS)
            out += np.bincount(row[: len(code)][good] * BUCKETS + bucket.astype(np.int64), minlength=len(out))
    return out.reshape(n, BUCKETS).astype(np.float32)


def junk(text: str) -> str:
    """A text of no language: the characters of ``text`` in random order, or random letters instead of its words; always the same for one text."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    text = text[:JUNK_CHARS]
    if rng.random() < 0.5:
        return "".join(rng.permutation(list(text)).tolist()) if text else ""
    letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), len(text)).tolist()
    return "".join(c if c.isspace() else x for c, x in zip(text, letters, strict=True))


@dataclass
class Model:
    languages: list[str]
    #: embeddings times softmax weights, so that a text's logits are its average row; the last column is text of no language
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    #: of the rows held back: share of right answers that are accepted, and of texts of no language that are rejected
    coverage: float = 1.0
    rejection: float = 0.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return softmax((counts / total @ self.weights + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Sparse = list[tuple[np.ndarray, np.ndarray]]


def gathered(features: Sparse, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that some rows use, and their shares as a dense matrix over those buckets only."""
    buckets = np.concatenate([features[i][0] for i in rows])
    used, place = np.unique(buckets, return_inverse=True)
    x = np.zeros((len(rows), len(used)), np.float32)
    x[np.repeat(np.arange(len(rows)), [len(features[i][0]) for i in rows]), place] = np.concatenate([features[i][1] for i in rows])
    return used, x


def fit(features: Sparse, labels: np.ndarray, languages: list[str], dims: int = 16, epochs: int = 12, batch: int = 16, rate: float = 20.0, seed: int = 7) -> Model:
    """Stochastic gradient descent on (buckets, shares) of each row; a fifth of the rows calibrates.

    Rows of no language have the label ``len(languages)``.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(features))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.normal(0, 0.5, (BUCKETS, dims)).astype(np.float32)
    weights, bias = np.zeros((dims, len(languages) + 1), np.float32), np.zeros(len(languages) + 1, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            used, x = gathered(features, rows)
            hidden = x @ embed[used]
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            embed[used] -= step * (x.T @ (error @ weights.T))
            weights -= 0.1 * step * (hidden.T @ error)
            bias -= 0.01 * step * error.sum(axis=0)
    model = Model(languages, embed @ weights, bias, 1.0, 0.0)
    if len(held):
        parts = [(gathered(features, held[i : i + 256])) for i in range(0, len(held), 256)]
        logits = np.concatenate([x @ model.weights[used] for used, x in parts]) + bias
        truth = np.arange(len(held)), labels[held]
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(logits / t)[truth] + 1e-12).mean()))
        top = softmax(logits / model.temperature)[:, :-1]
        score, none = top.max(axis=1), labels[held] == len(languages)
        right = top.argmax(axis=1) == labels[held]
        # rejects about one in a thousand of what the model gets right, and nothing that is more likely than not
        model.least = float(min(0.5, np.quantile(score[right], 0.001))) if right.any() else 0.0
        model.coverage = float((score[right] >= model.least).mean()) if right.any() else 1.0
        model.rejection = float((score[none] < model.least).mean()) if none.any() else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(labelled: DataFrame, per_language: int = 800, most_languages: int = 200) -> Model:
    """Fits a model on at most ``per_language`` rows (doc_id, text, lang) of each language.

    Rows are taken by the hash of their doc_id.  Null texts, languages and doc_ids take no
    part.  More than ``most_languages`` languages are an error, not a cut.  Without rows, the
    model knows no language.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a threshold on the hash first, so that hardly more than the sample is ranked
    below = F.lit(None)
    for lang, n in counts.items():
        below = F.when(F.col("lang") == lang, int(min(1.0, 2 * per_language / n) * (1 << 30))).otherwise(below)
    first = rows.withColumn("number", number).filter(F.col("number") <= below)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("number", "doc_id"))
    sample = first.select("doc_id", "lang", "number").withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id")
    chosen = first.join(F.broadcast(sample), "doc_id", "left_semi")  # per_language * most_languages ids at most

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=ROWS):
            texts = batch.column("text").to_pylist()
            shuffled = [junk(t) for t in texts if zlib.crc32(t.encode("utf-8", "replace")) % JUNK_EVERY == 0]
            for lang, column in ((batch.column("lang"), batch.column("text")), (pa.nulls(len(shuffled), pa.string()), pa.array(shuffled, pa.string()))):
                counts = feature_counts(column)
                used = [np.flatnonzero(c) for c in counts]
                yield pa.record_batch([lang, pa.array([u.astype(np.uint16).tobytes() for u in used], pa.binary()), pa.array([(c[u] / c.sum()).astype(np.float16).tobytes() for c, u in zip(counts, used, strict=True)], pa.binary())], ["lang", "buckets", "shares"])

    got = chosen.select("text", "lang").mapInArrow(sparse, "lang string, buckets binary, shares binary").collect()
    got.sort(key=lambda r: (r["lang"] is None, r["lang"] or "", r["buckets"], r["shares"]))
    features = [(np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float16).astype(np.float32)) for r in got]
    return fit(features, np.array([len(languages) if r["lang"] is None else languages.index(r["lang"]) for r in got]), languages)


def judge(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predicted language, score and whether it is rejected, of each text."""
    known = np.array([any(map(str.isalpha, t.as_py() or "")) for t in column], bool) & bool(model.languages)
    names, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
    if known.any():
        p = model.probabilities(feature_counts(column))[:, :-1]
        names[known] = np.array(model.languages, object)[p.argmax(axis=1)][known]
        score[known] = np.clip(p.max(axis=1)[known], 0.0, 1.0)
    return names, score, ~known | (score < model.least)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Predicts the language of every whole text.

    ``documents`` has doc_id and text.  Returns for each row: doc_id, lang_pred, score (the
    calibrated probability, 0 to 1) and rejected.  A text that is null or has no letter is
    ``und`` with score 0 and rejected, and so is any text if the model knows no language.
    Any other text gets a language, also if it is rejected.  Other columns are not looked at;
    no row is lost, and a repeated row gives a repeated row.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, "text", rows=ROWS):
            names, score, rejected = judge(batch.column("text"), model)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return documents.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents``, all columns, that the model does not reject.

    They are judged where they are, by their whole text alone, without a shuffle: a row may
    lack its doc_id, and repeated rows all stay or all go.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=ROWS):
            _, _, rejected = judge(batch.column("text"), held.value)
            yield batch.filter(pa.array(~rejected))

    return documents.mapInArrow(keep, documents.schema)
