"""Term counts, BM25 with and without a broadcast, and texts that hold one another, against plain versions; dense search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cobaltine.operators import retrieval


def words(rng, n):
    return " ".join(rng.choice(["the", "The", "a_b", "数据", "x1", "red", "blue", "green", "!"]) for _ in range(n))


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_bm25_against_a_plain_version(spark, monkeypatch, most):
    rng = random.Random(3)
    texts = {i: words(rng, rng.randint(0, 30)) for i in range(60)} | {60: None, 61: "", 62: "rare the the"}
    asked = {1: "the red rare", 2: "数据 数据 nothing", 3: None, 4: "x1"}
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", most)
    monkeypatch.setattr(retrieval, "MOST_COUNTED", 3)
    chunks = spark.createDataFrame(list(texts.items()), "id int, body string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25(queries, chunks, "id", "body", n=100).collect()}
    split = {i: [t.lower() for t in re.findall(retrieval.TOKEN, t or "")] for i, t in texts.items()}
    df = Counter(t for found in split.values() for t in set(found))
    raw = {t: math.log(len(split) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    low, mean = 0.25 * sum(raw.values()) / len(raw), sum(map(len, split.values())) / len(split)
    want = {}
    for q, text in asked.items():
        for i, found in split.items():
            tf = Counter(found)
            score = sum((raw[t] if raw[t] >= 0 else low) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(found) / mean)) for t in re.findall(retrieval.TOKEN, text or "") if t in df)
            if score > 0:
                want[q, i] = pytest.approx(score)
    assert got == want


def test_texts_that_hold_one_another(spark):
    rng = random.Random(4)
    made = lambda n: ["open " * rng.randint(0, 1) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    q, r = [*enumerate([*made(80), None, "OPEN", "`open` a**b**"])], [*enumerate([*made(80), None, "Open"])]
    got = {(x["query_id"], x["remark_id"]) for x in retrieval.match_remarks(spark.createDataFrame(q, "query_id int, text string"), spark.createDataFrame(r, "remark_id int, remark string")).collect()}
    plain = lambda t: re.sub(r"\*\*|__", "", re.sub("`([^`]+)`", r"\1", t or "")).strip().lower()
    want = {(i, j) for i, a in q for j, b in r if len(plain(a)) >= 3 and len(plain(b)) >= 4 and (plain(a) in plain(b) or plain(b) in plain(a))}
    assert got == want and len(want) > 20


def test_no_table_stays_persisted(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, text string")
    retrieval.bm25(docs.select(F.col("id").alias("query_id"), "text"), docs, "id", "text").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_vectors_meet_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_VALUES", 64)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(size=(250, 4)), np.repeat(rng.normal(size=(1, 4)), 150, axis=0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [1.0]), (901, None)], "id long, vector array<double>")
    found = retrieval.dense(rows.filter("id % 8 = 7 or id = 900").withColumnRenamed("id", "query_id"), rows, "id", 5)
    assert "Broadcast" not in found._jdf.queryExecution().toString()  # before: packed vectors went through the driver
    near = {}
    for r in found.orderBy("query_id", "rank").collect():
        near.setdefault(r["query_id"], []).append(r["id"])
    assert near.pop(900) == [900]
    assert near == {i: np.lexsort((np.arange(400), np.round(((vectors - vectors[i]) ** 2).sum(axis=1), 12)))[:5].tolist() for i in range(7, 400, 8)}


def test_matrix_bounds_lose_no_neighbour():
    rng = np.random.default_rng(1)
    q, v, ids = rng.normal(size=(40, 8)), rng.normal(size=(900, 8)), pa.array(rng.permutation(900))
    v[500:700], q[3], q[5], v[17], v[18], q[6] = v[0], v[0], np.nan, np.inf, 1e200, 1e200
    with np.errstate(all="ignore"):
        who, distance, found = retrieval.nearest(q, ((ids.slice(k, 100), v[k : k + 100]) for k in range(0, 900, 100)), 10)
        for i, one in enumerate(q):
            exact = ((v - one) ** 2).sum(axis=1)
            first = np.lexsort((ids.to_numpy(), np.round(exact, 12)))[:10]
            assert found.to_numpy()[who == i].tolist() == ids.to_numpy()[first].tolist()
            assert np.array_equal(distance[who == i], exact[first], equal_nan=True)
