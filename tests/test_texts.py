"""Text helpers, presets, sheets with a header, snapshots, limits of skills."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cobaltine.operators import catalogue, markdown, presets, reporting, series, sheets, texts
from cobaltine.sources import files


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_anchors(spark):
    assert column(spark, [" A  b-C!", "库存 (x)", "!?", None, "é_1", "--a--"], texts.anchor) == ["a-b-c", "库存-x", "section", "section", "é_1", "a"]


def test_json_in_replies(spark):
    given = ['{"a": 1}', 'x ```json\n{"a": {"b": 2}}\n``` y', '``` {"a": 3} ```', 'so {"a": 4} is', '{"a": ', "", None, '```json\n{bad}\n``` {"a": 5}']
    assert column(spark, given, texts.json_object) == ['{"a": 1}', '{"a": {"b": 2}}', '{"a": 3}', '{"a": 4}', None, None, None, None]
    assert column(spark, [" PY ", "formula", "builtin", "dsl", "", None, "other"], texts.skill_type) == ["python", "dsl", "preset", "dsl", "dsl", "dsl", "other"]


def test_best_match(spark):
    df = spark.createDataFrame([(1, "abcd", ["abcx", "abcdx", "zz"]), (2, "abcd", ["abxx", "q"]), (3, "a b", ["A  B"]), (4, "abcd", []), (5, "abcde", ["abcdx", "abcdy"])], "id int, v string, c array<string>")
    got = {r["id"]: r["m"] for r in df.select("id", texts.best_match(F.col("v"), F.col("c")).alias("m")).collect()}
    assert got == {1: "abcdx", 2: None, 3: "A  B", 4: None, 5: "abcdx"}
    assert spark.range(1).select(texts.windowed(F.lit("ab"), F.lit("wxyz")).alias("a"), texts.windowed(F.lit("abc"), F.lit("x")).alias("b")).first() == (["wx", "xy", "yz"], [])


def test_values_on_pages(spark):
    page = "Order ＡＢＣ-12\nTotal amount: 1,200.50\nPaid in full"
    values = [("1", "Paid", page), ("2", "abc-12", page), ("3", "PAID in\n1,200.50", page), ("4", "Tota1 amount", page), ("5", "amounf:", page), ("6", "nothing here", page), ("7", None, page), ("8", "x", None), ("9", "full\nempty", page)]
    got = {r["id"]: (r["status"], r["text"]) for r in texts.backed(spark.createDataFrame(values, "id string, value string, page string")).collect()}
    assert got == {
        "1": ("exact", "Paid"), "2": ("normalized", "abc-12"), "3": ("lines", "PAID in 1,200.50"), "4": ("missing", "Tota1 amount"), "5": ("fuzzy", "amount:"), "6": ("missing", "nothing here"),
        "7": ("empty", ""), "8": ("missing", "x"), "9": ("missing", "full\nempty"),
    }
    long = spark.createDataFrame([("1", "Pa1d in full on time", "Paid in full on time, ok\nx y")], "id string, value string, page string")
    assert texts.backed(long).first()[1:] == ("fuzzy", "Paid in full on time")


def test_fields(spark):
    item = StructType([StructField("d", LongType(), False), StructField("tags", ArrayType(StringType()))])
    schema = StructType([StructField("a", StructType([StructField("b", StringType())])), StructField("c", ArrayType(item))])
    assert texts.field_paths(schema) == [("a.b", "string", True), ("c[].d", "bigint", True), ("c[].tags", "array<string>", False)] or texts.field_paths(schema) == [("a.b", "string", False), ("c[].d", "bigint", True), ("c[].tags", "array<string>", False)]
    rows = spark.createDataFrame([("a.b",), ("c[0].d",), ("c[12].tags",)], "path string")
    of = lambda **k: [r["path"] for r in texts.chosen_fields(rows, **k).collect()]
    assert of() == ["a.b", "c[0].d", "c[12].tags"] and of(include=("c.d", "c")) == ["c[0].d"] and of(include=("c",), prefix=True) == ["c[0].d", "c[12].tags"]
    assert of(exclude=("c.d",)) == ["a.b", "c[12].tags"] and of(include=("c",), exclude=("c.t",), prefix=True) == ["c[0].d"]


def test_outline_and_names(spark):
    docs = spark.createDataFrame([(1, "# A\n## TOC\n### B\n#### deep\n```\n# code\n```\n## C"), (2, "text"), (3, None)], "id int, text string")
    assert [tuple(r) for r in texts.outline(docs, "id", "text").collect()] == [(1, "- A\n    - B\n  - C")]
    assert column(spark, ["doc/ab-doc.md", "doc/ab.md", "table/a-b.md", "project-overview.md", "x/ab-c.v1.md", "-.md"], lambda p: F.concat_ws(" ", *[texts.page_kind(p)[c] for c in ("module", "kind")])) == ["ab doc", "ab meta", "a-b meta", "project-overview meta", "ab meta", "misc meta"]
    assert column(spark, ["XP_FCST_2026-05.xlsx", "2026年5月", "2026_12", "p202601", "2026-13", "202601x", None], texts.period_of) == ["2026-05", "2026-05", "2026-12", "2026-01", None, None, None]
    assert column(spark, ["A_FCST_1", "FCSTX", "fcst", "FCST"], lambda c: texts.names_token(c, "FCST")) == [True, False, False, True]
    assert markdown.sections(docs.filter("id = 2"), "id", "text").count() == 1


def test_headed_sheets(spark):
    rows = [(1, 1, "title"), (2, 1, " part "), (2, 2, "qty"), (2, 3, "note"), (3, 1, "p1"), (3, 2, "#N/A"), (4, 1, " "), (4, 2, None), (4, 3, "only a note"), (5, 1, None), (5, 2, "3")]
    cells = spark.createDataFrame([("s", *r) for r in rows], "sheet string, row int, col int, value string")
    assert sorted(map(tuple, sheets.headed(cells, 2, {"part": "id", "qty": "n"}).collect())) == [("s", 3, "p1", None), ("s", 5, None, "3")]
    with pytest.raises(ValueError, match="s: no column lot"):
        sheets.headed(cells, 2, {"part": "id", "lot": "lot"})
    with pytest.raises(ValueError, match="unique"):
        sheets.headed(cells, 2, {"part": "id", "qty": "id"})
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert sorted(map(tuple, sheets.set_gaps(ids(1, 2, 2), ids(2, 3, 3), "k").collect())) == [(1, "missing"), (3, "extra")]


def test_presets(spark):
    df = spark.createDataFrame([("s", date(2025, 1, d), float(d)) for d in range(1, 11)], "series string, ds date, qty double")
    assert {r["qty"] for r in presets.forecast(df, "Moving Average", window=2).collect()} == {9.5}
    assert presets.named("ARIMA", presets.PRESETS) is presets.named(" auto-arima", presets.PRESETS)
    with pytest.raises(LookupError, match="'movin' is no preset, the closest is moving_average"):
        presets.named("movin", presets.PRESETS)
    own = presets.registry([presets.Preset("a b", series.moving_average, {"window": 3}, ("c",)), presets.Preset("c", series.cumulative_sum), presets.Preset("d", series.priority_fill, needs=("calls",))])
    assert presets.named("A-B", own).params == {"window": 3} and presets.named("c", own).forecast is series.cumulative_sum
    with pytest.raises(LookupError, match="d needs calls"):
        presets.forecast(df, "d", own)
    calls = spark.createDataFrame([("s", date(2025, 1, 1), 70.0), ("s", date(2025, 1, 2), 0.0)], "series string, ds date, qty double")
    assert sorted(r["qty"] for r in presets.forecast(df, "priority fill", inputs={"calls": calls}).collect())[-2:] == [10.0, 70.0]


def test_snapshots(spark, tmp_path):
    for v, text in ((1, "old"), (10, "new")):
        files.write_snapshot(spark.createDataFrame([(0, text), (1, None)], "turn int, text string"), str(tmp_path / "s"), v)
    assert sorted(map(tuple, files.snapshot(spark, str(tmp_path / "s"), "turn int, text string").collect())) == [(0, "new"), (1, None)]


def test_limits_of_skills(spark):
    df = spark.createDataFrame([(s, date(2025, 1, 1), q) for s, q in (("fast", 1.0), ("slow", 2.0), ("bad", 3.0))], "series string, ds date, qty double")
    code = "def forecast(points):\n    while points[0][1] == 2:\n        try:\n            sum(range(1000))\n        except Exception:\n            pass\n    return [{'date': points[0][0] + timedelta(days=3), 'qty': 1}] if points[0][1] == 1 else super(1)\n"
    results = catalogue.run_python(df, code, seconds=2).cache()
    got = {r["series"]: (r["ds"], r["error"]) for r in results.collect()}
    assert got == {"fast": (date(2025, 1, 4), None), "slow": (None, "TooLong: 2 s"), "bad": (None, "NameError: name 'super' is not defined")}
    assert reporting.batch_counts(results).first() == (1, 2)


def test_shown_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "x"), (1, 1, "user", "a"), (1, 2, "tool", "b"), (1, 3, "assistant", " "), (1, 4, "assistant", "c"), (1, 5, None, "d")], "conv_id int, turn int, role string, text string")
    assert [r["turn"] for r in reporting.shown_turns(turns).orderBy("turn").collect()] == [1, 4]
