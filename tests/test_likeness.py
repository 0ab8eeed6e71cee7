"""Ratios by the longest common subsequence against a plain table, best choices, and what blocking finds."""

import random

import pytest
from pyspark.sql import functions as F

from cobaltine.operators import likeness


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_ratios_against_a_plain_table():
    rng = random.Random(11)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc 中") for _ in range(rng.randint(0, 90 if rng.random() < 0.1 else 12))) for _ in range(2))
        want = 200 * plain_common(a, b) / (len(a) + len(b)) if a and b else 0.0
        assert likeness.ratio(a, b) == pytest.approx(want)
        if a and b:
            short, long = sorted((a, b), key=len)
            n = len(short)
            parts = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
            assert likeness.partial_ratio(a, b) == pytest.approx(max((200 * plain_common(short, p) / (n + len(p)) for p in parts if p), default=0.0))


def test_words_and_lengths():
    assert likeness.likeness("new york mets", "mets york new") == pytest.approx(95)
    assert likeness.likeness("fuzzy was a bear", "fuzzy fuzzy was a bear") == pytest.approx(95)
    assert likeness.likeness("abcd", "xxabcdxx") == pytest.approx(90)
    assert likeness.likeness("abcd", "x" * 30 + "abcd") == pytest.approx(60)
    assert likeness.likeness("", "a") == likeness.likeness("", "") == 0


def test_most_like(spark):
    rows = [("abcd", ["abxd", "ABC D", None, "abcd "]), ("abcd", ["zzzz"]), ("abcd", []), (None, ["a"]), ("abcd", None), ("aab", ["aa", "aabb"]), ("ＡＢＣ", ["abc"])]
    df = spark.createDataFrame(rows, "v string, c array<string>").select(likeness.most_like(F.col("v"), F.col("c")).alias("x"))
    assert [tuple(r["x"]) for r in df.collect()] == [("ABC D", 100.0), (None, None), (None, None), (None, None), (None, None), ("aa", 90.0), ("abc", 100.0)]


@pytest.mark.parametrize(("changes", "recall"), [(1, 1.0), (2, 0.99)])
def test_recall_of_blocking(spark, changes, recall):
    """Against all pairs: names of 8 to 24 letters, some letters of which are changed."""
    rng = random.Random(changes)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(4, 8)))
    pool = sorted({" ".join([rng.choice(["steel", "brass"]), word(), word()]) for _ in range(400)})
    values = []
    for text in pool:
        letters = list(text)
        for i in rng.sample(range(len(letters)), changes):
            letters[i] = rng.choice("xyz")
        values.append("".join(letters))
    frames = spark.createDataFrame([(v,) for v in [*values, None, "", "qqqq"]], "value string"), spark.createDataFrame([(t,) for t in [*pool, pool[0], None]], "text string")
    got = {r["value"]: r["score"] for r in likeness.alike(*frames).collect()}
    want = {v: s for v in set(values) if (s := likeness.closest(v, pool, 75.0)[1]) is not None}
    found = sum(got.get(v) == pytest.approx(s) for v, s in want.items())
    assert set(got) <= set(want) and found >= recall * len(want)
