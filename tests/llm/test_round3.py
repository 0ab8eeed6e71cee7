"""Links of small sets, texts of repeated items, blocks bounded by bytes."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cobaltine.llm import containment, hyperminhash, linededup, neardup
from cobaltine.llm.sql import OP8


def halves_of(rng, n, most):
    """Sets of 4 to ``most`` shingle hashes, and the same with a quarter more: similarity exactly 0.8."""
    for _ in range(n):
        common = 4 * int(rng.integers(1, most // 4 + 1))
        whole = rng.integers(0, 1 << 64, common + common // 4, dtype=np.uint64)
        yield np.sort(whole[:common]), np.sort(whole)


def test_no_link_of_small_sets_is_lost():
    """100,000 pairs at the threshold: all share a band, and no estimate is below what is asked."""
    rng, low, spread = np.random.default_rng(6), hyperminhash.least_estimate(0.8), []
    for _ in range(20):
        pairs = list(halves_of(rng, 5000, 20))
        a, b = (hyperminhash.registers(list(side)) for side in zip(*pairs, strict=True))
        seen = hyperminhash.estimate(a, b)
        assert (seen >= low).all()
        assert (hyperminhash.band_keys(a) == hyperminhash.band_keys(b)).any(axis=1).all()
        spread.append(seen)
    # registers are independent: the estimates spread as a binomial does
    assert abs(np.concatenate(spread).mean() - 0.8) < 0.001
    assert abs(np.concatenate(spread).std() - (0.8 * 0.2 / hyperminhash.REGISTERS) ** 0.5) < 0.0005


def test_least_estimate_is_the_binomial_tail():
    for similarity, loss in ((0.8, 1e-3), (0.85, 1e-2)):
        low = hyperminhash.least_estimate(similarity, loss)
        equal = np.random.default_rng(7).binomial(hyperminhash.REGISTERS, similarity, 2_000_000) / hyperminhash.REGISTERS
        raw = low * (1 - hyperminhash.COLLISION) + hyperminhash.COLLISION
        assert 0.1 * loss < (equal < raw).mean() <= loss


def test_registers_do_not_depend_on_how_sets_are_worked_on(monkeypatch):
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (0, 5, 700, 1, 0, 64, 3, 0)]
    want = hyperminhash.registers(sets)
    monkeypatch.setattr(hyperminhash, "AT_ONCE", 50)
    assert (hyperminhash.registers(sets) == want).all()
    assert not want[0].any() and (hyperminhash.registers([sets[2]]) == want[2]).all()


def test_short_texts_at_the_threshold_are_linked(spark):
    """Jaccard 4/5 for five-word shingles: many texts and the same with one word more."""
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(8)) + " end" * j) for i in range(600) for j in (0, 1)] + [(2 * 13154 + j, " ".join(f"w13154x{k}" for k in range(8)) + " end" * j) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, size=5, percent=80).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_groups_in_blocks_of_bytes(spark, monkeypatch):
    """Near copies in a chain, whose sets are larger than a block may be."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 512)
    rng, words = random.Random(9), [f"v{i}" for i in range(80)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words = [*words[rng.randint(1, 3) :], *(f"n{i}y{j}" for j in range(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, size=3, percent=85).collect()}
    assert got == root


# benchmark items


@pytest.mark.parametrize("options", [{}, {"block_shingles": 4}])
def test_each_text_of_a_repeated_item_is_searched(spark, options):
    word = lambda c, a, b: " ".join(f"{c}{i}" for i in range(a, b))
    items = [(7, word("w", 0, 10)), (7, word("z", 0, 10)), (7, word("z", 0, 10)), (8, word("q", 0, 6)), (9, None), (None, word("z", 0, 10)), (10, "too short")]
    docs = [(1, word("z", 0, 20)), (2, word("w", 0, 9)), (3, word("w", 0, 5)), (3, word("w", 4, 10)), (4, word("Q", 0, 30) + " " + word("w", 0, 12)), (None, word("z", 0, 20)), (5, None)]
    benchmark, documents = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = sorted(tuple(r) for r in containment.contained_items(documents, benchmark, **options).collect())
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.register(f"given_{name}", pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
        con.execute(f"create table {name} as select * from given_{name}")
    assert got == sorted(con.execute(OP8).fetchall())
    assert (1, 7, 6, 6, 1.0) in got and (4, 8, 2, 2, 1.0) in got and (4, 7, 6, 6, 1.0) in got
    kept = containment.without_items(documents, benchmark)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 3, 5]


# lines


def test_a_hot_text_is_split_where_arrays_are_not_broadcast(spark):
    """Texts meet what was found for them in a join of two shuffles, so that Spark can split it."""
    docs = spark.createDataFrame([(i, "Same line\nown %d" % (i % 7)) for i in range(60)], "doc_id long, text string")
    out = linededup.dedup_lines(docs, broadcast_bytes=0, shard_keys=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = linededup.dedup_lines(docs, broadcast_bytes=0, shard_keys=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("ENSURE_REQUIREMENTS") >= 2
    assert {r["kept"] for r in out.collect()} == {f"own {i}" for i in range(7)}
