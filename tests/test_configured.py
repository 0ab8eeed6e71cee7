"""Sheets read by configurations: header rows found, columns, rows, problems; dates by cell type."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cobaltine.operators import configured, sheets

CELL = "sheet string, row int, col int, value string, type string"
WIDE = ("w", "wide", None, None, None, None, [("part", "id")], "part", r"^\d{4}-\d{2}", None, None)


def cells_of(spark, **tables):
    rows = [(s, r, c, None if v is None else str(v), "number" if isinstance(v, int | float) else "text") for s, lines in tables.items() for r, line in enumerate(lines, 1) for c, v in enumerate(line, 1)]
    return spark.createDataFrame(rows, CELL)


def read(spark, cells, configurations, labels=None, **options):
    labels = labels or [(s["sheet"], configurations[0][0]) for s in cells.select("sheet").distinct().collect()]
    found = configured.parse(cells, spark.createDataFrame(labels, "sheet string, label string"), spark.createDataFrame(configurations, configured.CONFIGURATION), **options)
    rows = sorted((r["sheet"], r["row"], r["category"] or "", tuple(x["value"] for x in r["ids"]), r["name"] or "", r["qty"] or 0) for r in found.rows.collect())
    return rows, {r["sheet"]: r["problem"] for r in found.problems.collect()}


def test_header_rows_are_found_at_any_height(spark):
    head, body = ["part", "2025-01-01", "2025-02-01", "note"], ["p", 1, "2,000", "2025-01-01"]
    cells = cells_of(spark, first=[head, body], third=[["2025-01-01 title"], [None], head, body], noisy=[["x", "2025-01-01", "2025-01-02", "2025-01-03"], head, body], twice=[head, body, head, ["q", 5]])
    rows, problems = read(spark, cells, [WIDE])
    assert not problems
    assert [r for r in rows if r[0] == "third"] == [("third", 4, "", ("p",), "2025-01-01", 1), ("third", 4, "", ("p",), "2025-02-01", 2000)]
    assert {r[0]: r[1] for r in rows if r[0] != "twice"} == {"first": 2, "third": 4, "noisy": 3}
    assert [r[1:4] for r in rows if r[0] == "twice" and r[3] == ("q",)] == [(4, "", ("q",))]  # the upper of equal rows is the header


def test_rows_levels_and_joined_names(spark):
    blocks = ("b", "wide", None, None, {"kind": 1, "day": 2}, None, [("part", "id"), ("kind", "kind")], "part", r"^\d{4}", None, None)
    cells = cells_of(spark, b=[["", "plan", "plan", "fact"], ["part", "2025-01-01", "2025-01-02", "2025-01-01"], ["p", 1, 2, 3], [" ", 9, 9, 9], ["p", 4, "n/a", None]])
    rows, problems = read(spark, cells, [blocks])
    assert rows == [("b", 3, "", ("p", "fact"), "2025-01-01", 3), ("b", 3, "", ("p", "plan"), "2025-01-01", 1), ("b", 3, "", ("p", "plan"), "2025-01-02", 2), ("b", 5, "", ("p", "plan"), "2025-01-01", 4)] and not problems
    found = configured.parse(cells, spark.createDataFrame([("b", "b")], "sheet string, label string"), spark.createDataFrame([blocks], configured.CONFIGURATION))
    data = {tuple(x["value"] for x in r["ids"]): [tuple(x) for x in r["data"]] for r in configured.records(found.rows).collect()}
    assert data == {("p", "plan"): [("2025-01-01", 1), ("2025-01-02", 2), ("2025-01-01", 4)], ("p", "fact"): [("2025-01-01", 3)]}
    joined = ("j", "wide", 2, 3, None, [1, 2], [("part", "id")], None, r"^\d{4}", None, None)
    assert read(spark, cells, [joined])[0][0] == ("b", 4, "", (None,), "fact/2025-01-01", 9)


def test_simple_sheets(spark):
    simple = ("s", "simple", 1, None, None, None, [("No", "id"), ("Day", "day")], None, None, "Day", "yyyyMMdd")
    cells = cells_of(spark, s=[[" No ", "Day", "No", "other"], [7.0, 45658, "x", "y"], ["a", "3/2/2025", None, None], [None, None, "only others", "z"], ["b", "soon", None, None], ["#REF!", "2025年1月2日", None, None]])
    rows, problems = read(spark, cells, [simple])
    assert [r[3] for r in rows] == [("7", "20250101"), ("a", "20250203"), ("b", "soon"), (None, "20250102")] and not problems


def test_plans_hidden_columns_and_last_rows(spark):
    config = ("c", "complex", None, None, None, None, [("part", "id")], "part", None, None, None)
    cells = cells_of(spark, c=[["title"], ["part", 45658, "2025/1/2", 45660.5, 12345678], ["p", 1, 2, 3, 4], ["p", 5, None, 6, 7], ["q", 8, 8, 8, 8]])
    plan = spark.createDataFrame([("c", 3, "k"), ("c", 4, "k"), ("c", 4, "k"), ("c", 4, "l"), ("c", 99, "k")], "sheet string, row int, category string")
    hidden = spark.createDataFrame([("c", 4)], "sheet string, col int")
    rows, problems = read(spark, cells, [config], plan=plan, hidden_cols=hidden)
    assert rows == [("c", 3, "k", ("p",), "2025-01-01", 1), ("c", 3, "k", ("p",), "2025-01-02", 2), ("c", 4, "k", ("p",), "2025-01-01", 5), ("c", 4, "l", ("p",), "2025-01-01", 5)] and not problems
    found = configured.parse(cells, spark.createDataFrame([("c", "c")], "sheet string, label string"), spark.createDataFrame([config], configured.CONFIGURATION), hidden, plan)
    assert {(r["category"], tuple(map(tuple, r["data"]))) for r in configured.records(found.rows).collect()} == {("k", (("2025-01-02", 2.0), ("2025-01-01", 5.0))), ("l", (("2025-01-01", 5.0),))}
    assert read(spark, cells, [config])[1] == {"c": "no rows"}  # without a plan


def test_problems(spark):
    cells = cells_of(spark, none=[["x", 1], ["y", 2]], lacks=[["2025-01-01"], [1]], bare=[["part"], ["p"]], words=[["part", "2025-01-01"], ["p", "many"]])
    labels = [(s, "w") for s in ("none", "lacks", "bare", "words", "absent")] + [("other", "unknown")]
    rows, problems = read(spark, cells, [WIDE], labels)
    assert not rows
    assert problems == {"none": "no header", "lacks": "columns missing: part", "bare": "no column of quantities", "words": "no rows", "absent": "no header", "other": "no configuration"}
    assert read(spark, cells.limit(0), [WIDE], labels)[1]["bare"] == "no header"


@pytest.mark.parametrize(
    ("value", "kind", "day"),
    [
        ("45658", "number", date(2025, 1, 1)), ("45658", "text", None), ("45658", None, date(2025, 1, 1)), ("45658.75", "number", date(2025, 1, 1)), ("0", "number", None), ("73416", "number", None),
        ("20250102", "number", None), ("20250102", "text", date(2025, 1, 2)), ("20250102", None, date(2025, 1, 2)), ("true", "bool", None), ("2025-01-02", "bool", None), ("2025-01-02", "date", date(2025, 1, 2)), ("2025-01-02", "number", None),
        (" 2025-1-2 ", "text", date(2025, 1, 2)), ("2025-1/2", "text", None), ("2025.1.2", "text", date(2025, 1, 2)), ("2025.01.02 10:00:00", "text", None), ("2025/01/02 9:59:60", "text", date(2025, 1, 2)), ("2025-01-02 24:00:00", "text", None),
        ("2025-01-02T10:00:00", "text", None), ("31/12/2025", "text", date(2025, 12, 31)), ("12/31/2025", "text", date(2025, 12, 31)), ("02/03/2025", "text", date(2025, 3, 2)), ("31/02/2025", "text", None), ("02/30/2025", "text", None), ("13/13/2025", "text", None),
        ("2025-02-29", "text", None), ("0000-01-01", "text", None), ("2025年1月2日", "text", date(2025, 1, 2)), ("202512", "text", None), ("2025131", "text", None), ("", "text", None), (None, None, None),
    ],
)
def test_dates_by_cell_type(spark, value, kind, day):
    row = spark.createDataFrame([(value, kind)], "v string, k string").select(sheets.parse_date(F.col("v"), F.col("k")).alias("day"), sheets.date_kind(F.col("v"), F.col("k")).alias("kind")).first()
    assert row["day"] == day and (row["kind"] is None) == (day is None)
