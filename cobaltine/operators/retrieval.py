"""Retrieval over chunks: tokens, BM25, dense search, rank fusion, lookups, markdown sections.

Queries and chunks are tables; a search answers all queries in one job.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: fixed values: words of letters, digits and underscores, or single CJK characters
TOKEN = r"[A-Za-z0-9_]+|[一-鿿]"
#: fixed values: BM25 constants, and the constant of reciprocal rank fusion
K1, B, EPSILON, FUSION = 1.5, 0.75, 0.25, 60


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


#: rows of a table that is broadcast; beyond it tables meet in a shuffle
MOST_BROADCAST = 1_000_000
#: queries and chunks that are compared at once, and pairs that are measured at once
QUERY_BLOCK, CHUNK_BLOCK, PAIRS = 512, 2048, 65_536
#: numbers of the queries that a task holds, chunks of a column of cells at least, and cells that are filled before columns grow
QUERY_VALUES, CHUNK_ROWS, CELLS = 2_000_000, 8192, 256


#: distinct terms that a task counts before it hands their numbers on
MOST_COUNTED = 500_000


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df``, written once, and marked for a broadcast if its rows are few."""
    df = written(df, "small")
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Tokens of each row's text (column 1), as ``tokens`` gives them."""
    find = re.compile(TOKEN).findall
    for batch in batches:
        for text in batch.column(1).to_pylist():
            yield [t.lower() for t in find(text)] if text else []


def term_counts(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, n, letters): chunks that hold each term; the row without a term has the number of chunks and of all their tokens.

    Texts are split where they are read, and what a task counts is added up before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = Counter(), 0, 0
        for found in texts_of(batches):
            n, total = n + 1, total + len(found)
            held.update(set(found))
            if len(held) > MOST_COUNTED:
                yield pa.record_batch([pa.array(list(held)), pa.array(list(held.values())), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64())], names)
                held = Counter()
        terms = [*held, None]
        yield pa.record_batch([pa.array(terms, pa.string()), pa.array([*held.values(), 0], pa.int64()), pa.array([None] * len(held) + [n], pa.int64()), pa.array([None] * len(held) + [total], pa.int64())], names)

    names = ["term", "df", "n", "letters"]
    parts = chunks.select(key, text).mapInArrow(count, "term string, df long, n long, letters long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("letters").alias("letters"))


def postings(chunks: DataFrame, key: str, text: str, wanted: set[str] | None) -> DataFrame:
    """(key, length, term, tf) of the wanted terms, or of all; counted inside each row, so nothing is shuffled for it."""
    held = chunks.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, terms, tf = [], [], [], []
            for i, found in enumerate(texts_of([batch])):
                counted = Counter(found if held.value is None else [t for t in found if t in held.value])
                rows += [i] * len(counted)
                lengths += [len(found)] * len(counted)
                terms += counted
                tf += counted.values()
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], [key, "length", "term", "tf"])

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, text).mapInArrow(count, f"`{key}` {kind}, length long, term string, tf long")


def bm25(queries: DataFrame, chunks: DataFrame, key: str, text: str, n: int = 30) -> DataFrame:
    """The ``n`` best chunks of each query (query_id, text) with a score above zero; ties to the smaller key.

    Terms that more than half of the chunks hold would get a negative weight; they get
    EPSILON of the mean weight instead.  Texts are read twice, once for the numbers of the terms
    and once for the terms that are asked for; only counts and what they hit are shuffled.  If more
    than MOST_BROADCAST terms are asked for, all postings meet them in a join.
    """
    counted = written(term_counts(chunks, key, text), "terms")
    size = counted.filter("term is null").select("n", (F.col("letters") / F.col("n")).alias("mean_length"))
    weights = counted.filter("term is not null").select("term", "df").join(F.broadcast(size)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = weights.agg((F.avg("raw") * EPSILON).alias("floor"))
    idf = weights.join(F.broadcast(floor)).select("term", "mean_length", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    weighed = sent_if_small(asked.join(idf, "term"))
    terms = weighed.select("term").distinct().limit(MOST_BROADCAST + 1).toArrow().column(0).to_pylist()  # a bounded list of words
    found = postings(chunks, key, text, set(terms) if len(terms) <= MOST_BROADCAST else None)
    scored = found.join(weighed, "term").groupBy("query_id", key).agg(F.sum(part).alias("score")).filter("score > 0")
    return ranked(scored, n, F.desc(F.round("score", 6)), key)  # sums differ in their last bits


def ranked(scored: DataFrame, n: int, order: Column, key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, key))
    return scored.withColumn("rank", place).filter(F.col("rank") <= n)


def nearest_first(who: np.ndarray, distance: np.ndarray, ids: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ``n`` nearest of each query, ties to the smaller id; not a number is the farthest."""
    order = pa.compute.sort_indices(pa.table({"who": who, "near": np.round(distance, 12), "id": ids}), [("who", "ascending"), ("near", "ascending"), ("id", "ascending")]).to_numpy()
    place = who[order]
    kept = order[np.arange(len(order)) - np.searchsorted(place, place) < n]
    return who[kept], distance[kept], ids.take(pa.array(kept))


def nearest(q: np.ndarray, blocks: Iterator[tuple[pa.Array, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """(row of q, distance, id) of each query's ``n`` nearest among the blocks.

    A product of matrices bounds the distances from below and above; what the bounds leave
    is measured exactly.  Held are the queries, one block and a few times ``n`` rows a query.
    """
    size, slack = (q**2).sum(axis=1), 4 * (q.shape[1] + 4) * np.finfo(float).eps
    last = np.full(len(q), np.inf)  # distance of each query's n-th so far
    found: tuple | None = None
    waiting: list[tuple] = []

    def settled(rows: list[tuple]) -> tuple:
        who, distance, ids = nearest_first(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), pa.concat_arrays([r[2] for r in rows]), n)
        ends = np.searchsorted(who, np.arange(len(q)), "right")
        full = np.diff(ends, prepend=0) == n
        last[full] = np.fmin(np.inf, distance[ends[full] - 1])  # not a number bounds nothing
        return who, distance, ids

    for ids, v in blocks:
        with np.errstate(all="ignore"):
            sizes = (v**2).sum(axis=1)
            for i in range(0, len(q), QUERY_BLOCK):
                one = slice(i, i + QUERY_BLOCK)
                both, twice = size[one, None] + sizes, 2 * (q[one] @ v.T)
                most = last[one].copy()
                if len(v) >= n and np.isinf(most).any():
                    upper = np.where(np.isfinite(both), both * (1 + slack) - twice, np.inf)
                    most = np.fmin(most, np.partition(upper, n - 1, axis=1)[:, n - 1])
                # 1e-12: distances are ordered by twelve places
                left, right = np.nonzero(~((both * (1 - slack) - twice > most[:, None] + 2e-12) & np.isfinite(both)))
                for j in range(0, len(left), PAIRS):
                    who, which = left[j : j + PAIRS] + i, right[j : j + PAIRS]
                    waiting.append((who, ((v[which] - q[who]) ** 2).sum(axis=1), ids.take(pa.array(which))))
                    if sum(len(w[0]) for w in waiting) > PAIRS + 2 * n * len(q):
                        found, waiting = settled([*([found] if found else []), *waiting]), []
        if waiting and np.isinf(last).any():
            found, waiting = settled([*([found] if found else []), *waiting]), []
    return settled([*([found] if found else []), *waiting]) if found or waiting else None


def dense(queries: DataFrame, chunks: DataFrame, key: str, n: int = 30) -> DataFrame:
    """Exact nearest chunks by squared distance of (query_id, vector) to (key, vector).

    Queries are dealt to rows of cells by what a task can hold, chunks to columns; a
    task holds the queries of its cell, streams the chunks past them and hands on each query's ``n``
    nearest.  Nothing is broadcast.  All pairs are compared, so time is quadratic, memory is not.  Rows
    without a vector, or with one of another length than the query's, are no match.
    """
    kind, key_kind = "array<double>", chunks.schema[key].dataType.simpleString()
    q_kind = queries.schema["query_id"].dataType.simpleString()
    usable = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    asked, held = (df.filter(usable).select(F.col(c).alias("id"), F.col("vector").cast(kind).alias("vector"), F.size("vector").alias("dims")) for df, c in ((queries, "query_id"), (chunks, key)))
    values, all_held = asked.agg(F.sum("dims")).first()[0] or 0, held.count()
    rows = max(1, -(-values // QUERY_VALUES))
    columns = max(1, min(-(-all_held // CHUNK_ROWS), CELLS // rows))
    dealt = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = asked.select("dims", dealt(rows).alias("row"), every(columns).alias("column"), F.lit(0).alias("side"), F.col("id").alias("query_id"), none(key_kind).alias("key"), "vector")
    right = held.select("dims", every(rows).alias("row"), dealt(columns).alias("column"), F.lit(1).alias("side"), none(q_kind).alias("query_id"), F.col("id").alias("key"), "vector")
    met = left.unionByName(right).repartition(rows * columns, "dims", "row", "column").sortWithinPartitions("dims", "row", "column", "side")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Batches cut where the cell or the side changes."""
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("dims", "row", "column", "side")])
            cuts = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    yield tuple(marks[:, i].tolist()), batch.slice(i, j - i)

    def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
        return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)

    def blocks(parts: Iterator[tuple[tuple, pa.RecordBatch]], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for _, part in parts:
            for i in range(0, part.num_rows, CHUNK_BLOCK):
                piece = part.slice(i, CHUNK_BLOCK)
                yield piece.column("key"), matrix(piece, dims)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dims, *_), cell in groupby(runs(batches), lambda x: x[0][:3]):
            sides = groupby(cell, lambda x: x[0][3])
            side, parts = next(sides)
            if side:
                continue  # chunks that nobody asks for
            asking = [p for _, p in parts]
            if (chunk_side := next(sides, None)) is None:
                continue
            q_ids = pa.concat_arrays([p.column("query_id") for p in asking])
            q = np.concatenate([matrix(p, dims) for p in asking])
            if (found := nearest(q, blocks(chunk_side[1], dims), n)) is not None:
                who, distance, ids = found
                yield pa.record_batch([q_ids.take(pa.array(who)), ids, pa.array(distance), pa.array(np.round(distance, 12))], ["query_id", key, "distance", "near"])

    found = met.mapInArrow(near, f"query_id {q_kind}, {key} {key_kind}, distance double, near double")
    return ranked(found, n, F.asc("near"), key).drop("near")


def fuse(first: DataFrame, second: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Reciprocal rank fusion; ranks count from 0 in the sum."""
    both = first.select("query_id", key, "rank").unionByName(second.select("query_id", key, "rank"))
    scored = both.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (FUSION + F.col("rank") - 1)).alias("score"))
    return ranked(scored, n, F.desc("score"), key) if n else scored


def exclude(hits: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return hits.join(known.select("query_id", key).distinct(), ["query_id", key], "left_anti")


def boost(hits: DataFrame, preferred: Column, factor: float = 1.5) -> DataFrame:
    return hits.withColumn("score", F.when(preferred, F.col("score") * factor).otherwise(F.col("score")))


def normalize_url(url: Column) -> Column:
    """Path only: without host, query, fragment and trailing slash, with a leading one; case stays."""
    path = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def url_module(url: Column) -> Column:
    return F.lower(F.split_part(normalize_url(url), F.lit("/"), F.lit(2)))


#: fixed values: ranges of pictographs that mark cells
PICTOGRAPHS = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"


def strip_markdown(text: Column) -> Column:
    """Plain text of a cell: without code marks around text, pictographs and emphasis."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "`([^`]+)`", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, PICTOGRAPHS, ""), r"\*\*|__", ""))


def holding(long: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs (long, short) of distinct texts where the one holds the other.

    A short text asks with that of its three-letter parts which the fewest long ones have, so
    that an opening which many share does not bring them together; one with a part that no
    long text has is in none.
    """
    cut = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3))))
    held = long.select("long", F.explode(cut("long")).alias("part"))
    numbers = held.groupBy("part").agg(F.count("*").alias("n"))
    asked = short.withColumn("parts", cut("short")).select("short", F.size("parts").alias("all"), F.explode("parts").alias("part")).join(numbers, "part")
    rarest = asked.groupBy("short", "all").agg(F.min_by("part", F.struct("n", "part")).alias("part"), F.count("*").alias("found")).filter("found = all")
    return rarest.join(held, "part").filter(F.contains("long", "short")).select("long", "short")


def remark_groups(queries: DataFrame, remarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, q): the texts of queries; and (q, remark_id): the remarks that hold a text or that it holds, once for each distinct text."""
    q = queries.select("query_id", F.lower(strip_markdown(F.col("text"))).alias("q")).filter(F.length("q") >= 3)
    r = remarks.select("remark_id", F.lower(strip_markdown(F.col("remark"))).alias("r")).filter(F.length("r") >= 4)
    texts, said = written(q.select("q").distinct(), "texts"), written(r.select("r").distinct(), "said")
    of = lambda df, c, name: df.select(F.col(c).alias(name))
    found = holding(of(texts, "q", "long"), of(said, "r", "short")).select(F.col("long").alias("q"), F.col("short").alias("r"))
    more = holding(of(said, "r", "long"), of(texts, "q", "short")).select(F.col("short").alias("q"), F.col("long").alias("r"))
    return q, found.unionByName(more).distinct().join(r, "r").select("q", "remark_id").distinct()


def match_remarks(queries: DataFrame, remarks: DataFrame) -> DataFrame:
    """Pairs (query_id, remark_id) where one text holds the other; queries of 3 characters or more, remarks of 4 or more.

    Distinct texts are compared; who has them is joined to what is found.
    """
    q, held = remark_groups(queries, remarks)
    return q.join(held, "q").select("query_id", "remark_id").distinct()


def sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Text under each second-level heading; what comes before the first one is left out."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n##[ \t]+")
    found = documents.select(key, F.posexplode(parts).alias("section", "part")).filter("section > 0")
    return found.select(key, "section", F.trim(F.split_part("part", F.lit("\n"), F.lit(1))).alias("title"), F.length("part").alias("size"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "-"), "^-+|-+$", "")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: how much of the longer text needs no edit."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(F.round(100.0 * (1 - F.levenshtein(a, b) / longest), 2))


def validate(values: DataFrame) -> DataFrame:
    """How each (id, value, page) is backed by its page: exact, normalized, fuzzy (75 or more on a line) or missing."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    best = F.array_max(F.transform(F.split("page", "\n"), lambda line: similarity(F.lower(F.trim(line)), F.lower(F.trim(F.col("value"))))))
    status = F.when(F.contains("page", "value"), "exact").when(F.contains(squeeze(F.col("page")), squeeze(F.col("value"))), "normalized").when(best >= 75, "fuzzy").otherwise("missing")
    return values.select("id", status.alias("status"))


def search_query(url: Column, payload: Column, question: Column, priority: tuple[str, ...] = ()) -> Column:
    """One text to search with: the address, the payload's (map of strings) priority fields in their order, its others, the question.

    Null and empty values are left out; fields read ``name=value``.
    """
    shown = lambda k, v: F.when(v.isNotNull() & (v != ""), F.concat(k, F.lit("="), v))
    chosen = [shown(F.lit(k), F.try_element_at(payload, F.lit(k))) for k in priority]
    others = F.array_compact(F.transform(F.map_entries(F.coalesce(payload, F.create_map().cast("map<string,string>"))), lambda e: F.when(~e["key"].isin(*priority) if priority else F.lit(True), shown(e["key"], e["value"]))))
    return F.concat_ws(" | ", url, *chosen, F.array_join(F.when(F.size(others) > 0, others), " | "), F.when(question != "", question))


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, top_k: int = 8, pool: int = 30, known: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25 and, with vectors, dense ranks fused; the query's module counts more; known hits go.

    ``queries`` has query_id, text, module (may be null) and, for ``vectors`` (chunk_id,
    vector), vector; ``chunks`` chunk_id, text and module; ``known`` query_id and chunk_id.
    """
    found = bm25(queries, chunks, "chunk_id", "text", pool)
    merged = fuse(dense(queries, vectors, "chunk_id", pool) if vectors is not None else found.limit(0), found, "chunk_id")
    placed = merged.join(chunks.select("chunk_id", F.col("module").alias("chunk_module")), "chunk_id").join(queries.select("query_id", "module"), "query_id")
    scored = boost(placed, F.coalesce(F.col("module") == F.col("chunk_module"), F.lit(False))).select("query_id", "chunk_id", "score")
    return ranked(exclude(scored, known, "chunk_id") if known is not None else scored, top_k, F.desc(F.round("score", 12)), "chunk_id")


def prompt(hits: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One text for each query: its hits' bodies in order of rank."""
    joined = hits.join(chunks.select(key, "title", "body"), key)
    line = F.concat_ws("\n", F.concat(F.lit("### "), "title"), "body")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("text")))), lambda x: x["text"])
    return joined.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("prompt"))
